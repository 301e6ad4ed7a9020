"""Rectangles, filters and lookups."""

from __future__ import annotations

from ..plans.dual import operator
from ..plans.fixtures import TOKEN_TYPES

OPEN = '(t."right" > r."left" and t."left" < r."right" and t.bottom > r.top and t.top < r.bottom)'
CLOSED = '(t."right" >= r."left" and t."left" <= r."right" and t.bottom >= r.top and t.top <= r.bottom)'
ON_PAGE = "t.doc_id = r.doc_id and t.page_number = r.page_number"
INTER = '(least(t."right", r."right") - greatest(t."left", r."left")) * (least(t.bottom, r.bottom) - greatest(t.top, r.top))'

#: Side of a tile, and the last tile each way: what lies further out is in the last one, so a box has a bounded number of tiles.
TILE, LAST_TILE = 128, 127


def _edges(p: str) -> tuple[str, str, str, str]:
    return f'{p}"left"', f'{p}"right"', f"{p}top", f"{p}bottom"


def tile(x: str) -> str:
    return f"cast(least(greatest(floor(({x}) / {TILE}), 0), {LAST_TILE}) as int)"


def tiled(d, a: str, b: str, names: tuple[str, str] = ("t", "r"), a_edges=_edges, b_edges=_edges) -> str:
    """`a t join b r on` page, to be followed by a condition that boxes overlap or touch. Spark deals both sides to the tiles of
    the page that their boxes lie in and joins by tile; a pair is met in the tile of its intersection's upper left corner
    alone. So a page is shared among tasks, and boxes far apart don't meet. a_edges, b_edges: left, right, top, bottom of a
    side's boxes, with a prefix for its columns."""
    x, y = names
    on = f"{x}.doc_id = {y}.doc_id and {x}.page_number = {y}.page_number"
    if d.name != "spark":
        return f"{a} {x} join {b} {y} on {on}"

    def dealt(relation: str, edges) -> str:
        left, right, top, bottom = map(tile, edges(""))
        return f"(select *, explode(sequence({left}, {right})) as tile_x from (select *, explode(sequence({top}, {bottom})) as tile_y from {relation}))"

    (xl, _, xt, _), (yl, _, yt, _) = a_edges(f"{x}."), b_edges(f"{y}.")
    met = f"{x}.tile_x = {y}.tile_x and {x}.tile_y = {y}.tile_y and {x}.tile_x = {tile(f'greatest({xl}, {yl})')} and {x}.tile_y = {tile(f'greatest({xt}, {yt})')}"
    return f"{dealt(a, a_edges)} {x} join {dealt(b, b_edges)} {y} on {on} and {met}"


@operator("raw")
def rect_fix(d):
    """Corrected rectangles: a side of no length is widened by one each way, then reversed sides are swapped."""
    return f"""select doc_id, page_number, region_seq, least(l, r) as "left", least(t, b) as top, greatest(l, r) as "right", greatest(t, b) as bottom, abs(r - l) as width, abs(b - t) as height from (
 select doc_id, page_number, region_seq, case when "left" = "right" then "left" - 1 else "left" end as l, case when "left" = "right" then "right" + 1 else "right" end as r, case when top = bottom then top - 1 else top end as t, case when top = bottom then bottom + 1 else bottom end as b from {d.t('raw')}) x"""


@operator("tok", "reg")
def intersection_pct(d):
    """Percentage of the token's area that the region covers; 0 without an open overlap."""
    return f"""select t.doc_id, t.page_number, t.pos, r.region_seq, case when {OPEN} then 100.0 * cast({INTER} as double) / (t.width * t.height) else cast(0 as double) end as pct
 from {d.t('tok')} t join {d.t('reg')} r on {ON_PAGE}""".replace("100.0 *", "cast(100 as double) *")


def _overlaps(d, condition: str) -> str:
    return f"""select t.doc_id, t.page_number, t.pos, cast(coalesce(m.n, 0) as bigint) as n from {d.t('tok')} t join (select distinct doc_id, page_number from {d.t('reg')}) p on t.doc_id = p.doc_id and t.page_number = p.page_number
 left join (select t.doc_id, t.page_number, t.pos, count(*) as n from {tiled(d, d.t('tok'), d.t('reg'))} and {condition} group by t.doc_id, t.page_number, t.pos) m on t.doc_id = m.doc_id and t.page_number = m.page_number and t.pos = m.pos"""


@operator("tok", "reg")
def rect_overlap_open(d):
    """How many regions each token overlaps, on pages with regions."""
    return _overlaps(d, OPEN)


@operator("tok", "reg")
def rect_overlap_closed(d):
    """How many regions each token overlaps or touches, on pages with regions."""
    return _overlaps(d, CLOSED)


@operator("names")
def token_type_lookup(d):
    """Token types of an index k and a name n: by index (out of range: Text, as -1 wraps to the last), by upper-cased name and by display value (unknown: Text)."""
    names = " ".join(f"when '{n}' then {i}" for i, (n, _) in enumerate(TOKEN_TYPES))
    values = " ".join(f"when '{v}' then {i}" for i, (_, v) in enumerate(TOKEN_TYPES))
    display = " ".join(f"when {i} then '{v}'" for i, (_, v) in enumerate(TOKEN_TYPES))
    return f"""select doc_id, page_number, pos, k, case when k >= 0 then case k {display} else 'Text' end when k >= -11 then case k + 11 {display} end else 'Text' end as by_index,
 case upper(n) {names} else 6 end as by_name, case n {values} else 6 end as by_value from {d.t('names')}"""


@operator("reg")
def region_size_filter(d):
    """Regions of enough area, width and height at 100 dpi (limits scale linearly with dpi)."""
    s = lambda v: f"greatest(1, {d.trunc(f'{v} * cast(100 as double) / 150')})"
    return f"select doc_id, page_number, region_seq, area, width, height from {d.t('reg')} where area >= {s(2000)} and width >= {s(60)} and height >= {s(40)}"


@operator("reg")
def region_shape_filter(d):
    """Aspect within [0.05, 20]; fill and edge over the grayscale minima, or fill within the morphological range."""
    return f"""select doc_id, page_number, region_seq, fill_density >= 0.15 and edge_density >= 0.02 as grayscale, fill_density >= 0.02 and fill_density <= 0.90 as morphological from {d.t('reg')}
 where aspect_ratio between 0.05 and 20 and ((fill_density >= 0.15 and edge_density >= 0.02) or (fill_density >= 0.02 and fill_density <= 0.90))"""


@operator("cand", "page")
def region_page_fraction(d):
    """Regions of less than 70 % of their page."""
    fraction = "cast(r.area as double) / (p.page_width * p.page_height)"
    return f"""select r.doc_id, r.page_number, r.region_seq, {fraction} as fraction from {d.t('cand')} r join {d.t('page')} p on r.doc_id = p.doc_id and r.page_number = p.page_number where {fraction} < 0.70"""


@operator("page", "printed", "pictured")
def pages_needing_detection(d):
    """Pages with an embedded image or without tokens."""
    return f"""select p.doc_id, p.page_number from {d.t('page')} p where exists (select 1 from {d.t('pictured')} i where i.doc_id = p.doc_id and i.page_number = p.page_number)
 or not exists (select 1 from {d.t('printed')} t where t.doc_id = p.doc_id and t.page_number = p.page_number)"""


@operator("page", "printed")
def scanned_pages(d):
    """Pages without tokens."""
    return f"""select p.doc_id, p.page_number from {d.t('page')} p where not exists (select 1 from {d.t('printed')} t where t.doc_id = p.doc_id and t.page_number = p.page_number)"""


@operator("box")
def tsr_box_filter(d):
    return f"select doc_id, page_number, region_seq, seq, x, y, w, h from {d.t('box')} where w < 0.9 * img_w and h < 0.9 * img_h"


@operator("box")
def sort_boxes(d):
    """Boxes in the four orders; equal keys keep their place."""
    return f"""select doc_id, page_number, region_seq, seq, cast(row_number() over (partition by doc_id, page_number, region_seq order by x, seq) as int) as left_to_right, cast(row_number() over (partition by doc_id, page_number, region_seq order by x desc, seq) as int) as right_to_left,
 cast(row_number() over (partition by doc_id, page_number, region_seq order by y, seq) as int) as top_to_bottom, cast(row_number() over (partition by doc_id, page_number, region_seq order by y desc, seq) as int) as bottom_to_top from {d.t('box')}"""


@operator("reg")
def region_px_to_pt(d):
    """Pixels to points at the reduced detection resolution; truncation toward zero."""
    dpi = f"greatest(72, {d.trunc('150 * cast(0.67 as double)')})"
    scale = f"(cast({dpi} as double) / 72)"
    cut = lambda c: d.trunc(f"{c} / {scale}")
    return f"""select doc_id, page_number, region_seq, {dpi} as dpi, {cut('"left"')} as "left", {cut('top')} as top, {cut('width')} as width, {cut('height')} as height from {d.t('reg')}"""


@operator("cand", "page")
def crop_box(d):
    """Pixel box of a region's crop at 150 dpi, cut to the page; truncation toward zero. Regions of which nothing is on the page
    have no crop."""
    s = "(cast(150 as double) / 72)"
    cut = lambda c: d.trunc(f"{c} * {s}")
    return f"""select * from (select r.doc_id, r.page_number, r.region_seq, greatest(0, {cut('r."left"')}) as x0, greatest(0, {cut('r.top')}) as y0, least({cut('p.page_width')}, {cut('r."right"')}) as x1, least({cut('p.page_height')}, {cut('r.bottom')}) as y1
 from {d.t('cand')} r join {d.t('page')} p on r.doc_id = p.doc_id and r.page_number = p.page_number) c where x1 > x0 and y1 > y0"""


@operator("lab", "tok")
def label_discrepancy(d):
    return f"""select l.doc_id, l.page_number, l.seq, abs(l."left" - t."left") + abs(l.top - t.top) + abs(l.height - t.height) + abs(l.width - t.width) as discrepancy
 from {d.t('lab')} l join {d.t('tok')} t on l.doc_id = t.doc_id and l.page_number = t.page_number and l.seq = t.pos"""


@operator("judged")
def mistake_type(d):
    """0 correct, 1 wrong, 2 missing (1 predicted as 0); predictions are rounded half to even."""
    return f"""select doc_id, page_number, pos, seq, case when truth = guess then 0 when truth = 1 and guess = 0 then 2 else 1 end as mistake from (select *, {d.half_even('prediction')} as guess from {d.t('judged')}) x"""
