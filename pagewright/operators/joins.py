"""Joins: by place on the page, by key, nearest and contained. Overlaps are joined by tiles of the page (geometry.tiled), the others
on document and page."""

from __future__ import annotations

from ..functions.characters import DIGIT
from ..plans.dual import operator
from ..plans.fixtures import DISPLAY, TOKEN_TYPES
from .geometry import CLOSED, INTER, OPEN, tiled

IMAGES = "('Photo', 'Figure', 'Picture', 'Chart', 'Logo')"
PLACED = "('Table', 'Picture', 'Photo', 'Figure', 'Chart')"


@operator("tok", "lab")
def label_assign(d):
    """Each token's label: the first by area that it fills over 95 %, else the one that it fills most; Text without any."""
    r = 'r."left" + r.width'
    inter = f'cast((least(t."right", {r}) - greatest(t."left", r."left")) * (least(t.bottom, r.top + r.height) - greatest(t.top, r.top)) as double)'
    hit = f't."right" > r."left" and t."left" < {r} and t.bottom > r.top and t.top < r.top + r.height'
    edges = lambda p: (f'{p}"left"', f'{p}"left" + {p}width', f"{p}top", f"{p}top + {p}height")
    return f"""with m as (select t.doc_id, t.page_number, t.pos, r.label_type, r.width * r.height as area, r.seq, cast(100 as double) * {inter} / (r.width * r.height) as pct from {tiled(d, d.t('tok'), d.t('lab'), b_edges=edges)} and {hit}),
 k as (select *, row_number() over (partition by doc_id, page_number, pos order by case when pct > 95 then 0 else 1 end, case when pct > 95 then 0 else -pct end, area, seq) as rn from m)
 select t.doc_id, t.page_number, t.pos, coalesce(k.label_type, 6) as label_type from {d.t('tok')} t left join (select * from k where rn = 1) k on t.doc_id = k.doc_id and t.page_number = k.page_number and t.pos = k.pos"""


@operator("tok", "reg")
def token_region_overlap(d):
    """Whether any region but a scanned page touches the token; tokens of one place share the last one's answer."""
    others = f"(select * from {d.t('reg')} where region_type <> 'ScannedPage')"
    return f"""with m as (select distinct t.doc_id, t.page_number, t.pos from {tiled(d, d.t('tok'), others)} and {CLOSED}),
 o as (select t.doc_id, t.page_number, t."left", t.top, t.pos, m.pos is not null as touches from {d.t('tok')} t left join m on t.doc_id = m.doc_id and t.page_number = m.page_number and t.pos = m.pos)
 select doc_id, page_number, "left", top, touches from (select *, row_number() over (partition by doc_id, page_number, "left", top order by pos desc) as rn from o) x where rn = 1"""


@operator("reg", "tsr")
def region_tsr_json(d):
    """Table structure of a region by page and full box; the last of a box wins."""
    box = 'doc_id, page_number, "left", top, "right", bottom'
    last = "max_by" if d.name == "spark" else "arg_max"
    return f"""with x as (select {box}, 'Table' as region_type, max(tsr_seq) as tsr_seq, {last}(num_cells, tsr_seq) as num_cells from {d.t('tsr')} group by {box})
 select r.doc_id, r.page_number, r.region_seq, r.region_type, x.tsr_seq, x.num_cells from {d.t('reg')} r left join x
 on r.doc_id = x.doc_id and r.page_number = x.page_number and r.region_type = x.region_type and r."left" = x."left" and r.top = x.top and r."right" = x."right" and r.bottom = x.bottom"""


@operator("reg", "tsr")
def region_tsr_md(d):
    """Table structure of a region by page and corner; the last of a corner wins."""
    return f"""select r.doc_id, r.page_number, r.region_seq, x.tsr_seq, x.num_cells from (select * from {d.t('reg')} where region_type = 'Table') r left join (
 select * from (select *, row_number() over (partition by doc_id, page_number, "left", top order by tsr_seq desc) as rn from {d.t('tsr')}) y where rn = 1) x
 on r.doc_id = x.doc_id and r.page_number = x.page_number and r."left" = x."left" and r.top = x.top"""


@operator("cell", "tok")
def cell_text_json(d):
    """Text of the tokens that overlap a cell's box, which is not moved to its region."""
    on = 't."right" > c.x and t."left" < c.x + c.w and t.bottom > c.y and t.top < c.y + c.h'
    once = "" if d.name == "spark" else "materialized "  # else that engine plans the join over both derivations again
    edges = lambda p: (f"{p}x", f"{p}x + {p}w", f"{p}y", f"{p}y + {p}h")
    return f"""with cells as {once}(select doc_id, page_number, region_seq, "row", col, x, y, w, h from {d.t('cell')}), toks as {once}(select doc_id, page_number, pos, content, "left", top, "right", bottom from {d.t('tok')}),
 met as (select c.doc_id, c.page_number, c.region_seq, c."row", c.col, t.pos, t.content from {tiled(d, 'cells', 'toks', ('c', 't'), edges)} and {on} union all select doc_id, page_number, region_seq, "row", col, cast(null as int) as pos, cast(null as {'string' if d.name == 'spark' else 'varchar'}) as content from cells)
 select doc_id, page_number, region_seq, "row", col, coalesce({d.listagg('content', "' '", 'pos')}, '') as txt from met group by doc_id, page_number, region_seq, "row", col"""


def _cell_parts(d, cells: str = "") -> str:
    """CTEs up to texts(doc_id, page_number, region_seq, row, col, txt), by way of what each token gives to each cell. cells: a
    relation in place of `cell`."""
    ox = '(least(t."right", c.region_left + c.x + c.w) - greatest(t."left", c.region_left + c.x))'
    oy = "(least(t.bottom, c.region_top + c.y + c.h) - greatest(t.top, c.region_top + c.y))"
    edges = lambda p: (f"{p}region_left + {p}x", f"{p}region_left + {p}x + {p}w", f"{p}region_top + {p}y", f"{p}region_top + {p}y + {p}h")
    n = d.half_even('ox / sum_ox * nw')
    words = d.words("content")
    if d.name == "spark":
        part = "array_join(slice(ws, cast(taken + 1 as int), cast(greatest(n, 0) as int)), ' ')"
        size = f"size({words})"
    else:
        part = "array_to_string(list_slice(ws, taken + 1, taken + greatest(n, 0)), ' ')"
        size = f"len({words})"
    near, toks = "", d.t("tok")
    if d.name == "spark":  # few tokens of a page lie among its cells; the others aren't dealt to tiles
        x0, x1, y0, y1 = edges("")
        near = f"""spans as (select doc_id, page_number, min({x0}) as x0, max({x1}) as x1, min({y0}) as y0, max({y1}) as y1 from {cells or d.t('cell')} group by doc_id, page_number),
 near as (select t.doc_id, t.page_number, t.pos, t.content, t."left", t.top, t."right", t.bottom, t.width, t.height from {toks} t join spans s on t.doc_id = s.doc_id and t.page_number = s.page_number and t."right" > s.x0 and t."left" < s.x1 and t.bottom > s.y0 and t.top < s.y1),
 """
        toks = "near"
    return f"""{near}hits as (select c.doc_id, c.page_number, c.region_seq, c."row", c.col, c."row" * 1000 + c.col as cell_order, t.pos, t."left", t.content, cast({ox} as double) as ox
  from {tiled(d, cells or d.t('cell'), toks, ('c', 't'), edges)} and {ox} > 0 and {oy} > 0 and t.width * t.height > 0 and {ox} * {oy} * 100 / (t.width * t.height) >= 10),
 rows_ as (select doc_id, page_number, region_seq, pos, "row", sum(ox) as row_ox, min(cell_order) as first_seen from hits group by doc_id, page_number, region_seq, pos, "row"),
 best as (select * from (select *, row_number() over (partition by doc_id, page_number, region_seq, pos order by row_ox desc, first_seen) as rn from rows_) x where rn = 1),
 own as (select h.*, b.row_ox as sum_ox, {size} as nw, {words} as ws, count(*) over (partition by h.doc_id, h.page_number, h.region_seq, h.pos) as cells,
   row_number() over (partition by h.doc_id, h.page_number, h.region_seq, h.pos order by h.col) as k
   from hits h join best b on h.doc_id = b.doc_id and h.page_number = b.page_number and h.region_seq = b.region_seq and h.pos = b.pos and h."row" = b."row"),
 wanted as (select *, greatest(1, {n}) as want from own),
 run as (select *, least(nw, coalesce(sum(want) over (partition by doc_id, page_number, region_seq, pos order by k rows between unbounded preceding and 1 preceding), 0)) as taken from wanted),
 cut as (select *, least(want, nw - taken) as n from run),
 parts as (select doc_id, page_number, region_seq, "row", col, "left", pos, case when cells = 1 then content else {part} end as part from cut),
 texts as (select doc_id, page_number, region_seq, "row", col, {d.listagg('part', "' '", '"left", pos')} as txt from parts where part <> '' group by doc_id, page_number, region_seq, "row", col)"""


@operator("cell", "tok")
def cell_text_md(d):
    """Cell text for Markdown: a token goes to the row that it overlaps most, its words shared out among that row's cells."""
    return f"""with {_cell_parts(d)} select doc_id, page_number, region_seq, "row", col, txt from texts"""


def _table_md(d, cells: str = "") -> str:
    """CTEs up to tables(doc_id, page_number, region_seq, md). The grid is whole, from row and column 0 to the last ones that
    have a cell: places without a cell are empty."""
    nl = d.newline
    return f"""{_cell_parts(d, cells)},
 extent as (select doc_id, page_number, region_seq, cast(max("row") as int) as rows_, cast(max(col) as int) as cols_ from {cells or d.t('cell')} group by doc_id, page_number, region_seq),
 lanes as (select doc_id, page_number, region_seq, cols_, {d.upto('rows_')} as "row" from extent),
 grid as (select doc_id, page_number, region_seq, "row", {d.upto('cols_')} as col from lanes),
 filled as (select c.doc_id, c.page_number, c.region_seq, c."row", c.col, coalesce(t.txt, '') as txt from grid c left join texts t
  on c.doc_id = t.doc_id and c.page_number = t.page_number and c.region_seq = t.region_seq and c."row" = t."row" and c.col = t.col),
 md_rows as (select doc_id, page_number, region_seq, "row", concat('| ', {d.listagg('txt', "' | '", 'col')}, ' |') as line, concat('| ', {d.listagg("'---'", "' | '", 'col')}, ' |') as rule from filled group by doc_id, page_number, region_seq, "row"),
 tables as (select doc_id, page_number, region_seq, {d.listagg(f'''case when "row" = 0 then concat(line, {nl}, rule) else line end''', nl, '"row"')} as md from md_rows group by doc_id, page_number, region_seq)"""


@operator("cell", "tok")
def md_table(d):
    """A region's cells as a Markdown table with a rule after the first row."""
    return f"with {_table_md(d)} select doc_id, page_number, region_seq, md from tables"


@operator("tok", "pred")
def apply_predictions(d):
    """A token's type: of the last prediction at its place, else of the nearest under 20 away, else Text."""
    return f"""with exact as (select * from (select t.doc_id, t.page_number, t.pos, p.token_type, row_number() over (partition by t.doc_id, t.page_number, t.pos order by p.seq desc) as rn from {d.t('tok')} t join {d.t('pred')} p on t.doc_id = p.doc_id and t.page_number = p.page_number and t."left" = p."left" and t.top = p.top) x where rn = 1),
 missed as (select t.* from {d.t('tok')} t left join exact e on t.doc_id = e.doc_id and t.page_number = e.page_number and t.pos = e.pos where e.pos is null),
 nearest as (select * from (select t.doc_id, t.page_number, t.pos, p.token_type, row_number() over (partition by t.doc_id, t.page_number, t.pos order by abs(t."left" - p."left") + abs(t.top - p.top), p.seq) as rn from missed t join {d.t('pred')} p on t.doc_id = p.doc_id and t.page_number = p.page_number
  where abs(t."left" - p."left") + abs(t.top - p.top) < 20) x where rn = 1)
 select t.doc_id, t.page_number, t.pos, coalesce(e.token_type, n.token_type, 6) as token_type from {d.t('tok')} t left join exact e on t.doc_id = e.doc_id and t.page_number = e.page_number and t.pos = e.pos
 left join nearest n on t.doc_id = n.doc_id and t.page_number = n.page_number and t.pos = n.pos"""


@operator("reg")
def dedup_regions(d):
    """Regions without the image-like ones that lie within a larger (or as large, earlier) image-like one."""
    return f"""select r.doc_id, r.page_number, r.region_seq, r.region_type, r.area from {d.t('reg')} r where not (r.region_type in {IMAGES} and exists (
 select 1 from {d.t('reg')} k where k.doc_id = r.doc_id and k.page_number = r.page_number and k.region_type in {IMAGES} and (k.area > r.area or (k.area = r.area and k.region_seq < r.region_seq))
 and k."left" <= r."left" and k.top <= r.top and k."right" >= r."right" and k.bottom >= r.bottom))"""


def _closest_below(tok):
    from .sweep import sweep

    return sweep(tok).where("below is not null").selectExpr("doc_id", "page_number", "pos", "below as gap")


@operator("tok", spark=_closest_below)
def closest_below(d):
    """Gap to the nearest token that starts below, where there is one."""
    return f"""select t.doc_id, t.page_number, t.pos, cast(min(o.top) - t.bottom as int) as gap from {d.t('tok')} t join (select distinct doc_id, page_number, top from {d.t('tok')}) o
 on t.doc_id = o.doc_id and t.page_number = o.page_number and o.top > t.bottom group by t.doc_id, t.page_number, t.pos, t.bottom"""


SAME_LINE = "o.doc_id = t.doc_id and o.page_number = t.page_number and o.top between t.top - t.height and t.top + t.height and ((o.top <= t.top and t.top < o.bottom) or (o.top < t.bottom and t.bottom <= o.bottom))"
SAME_LINE_OF = "o.top >= t.top - t.height and o.top <= t.top + t.height and ((o.top <= t.top and t.top < o.top + o.height) or (o.top < t.bottom and t.bottom <= o.top + o.height))"
LINE_JOIN = f"t.doc_id = o.doc_id and t.page_number = o.page_number and {SAME_LINE_OF}"


@operator("tok")
def same_line_pairs(d):
    """How many tokens share each token's line (itself included), and the range of their positions."""
    return f"""select t.doc_id, t.page_number, t.pos, count(*) as n, min(o.pos) as first_pos, max(o.pos) as last_pos from {d.t('tok')} t join {d.t('tok')} o on {LINE_JOIN} group by t.doc_id, t.page_number, t.pos"""


def _top_distance_gap(tok):
    from .sweep import sweep

    return sweep(tok).where("gap is not null").select("doc_id", "page_number", "pos", "gap")


@operator("tok", spark=_top_distance_gap)
def top_distance_gap(d):
    """Vertical distance to the next token, corrected for the tokens that start in between."""
    return f"""with p as (select *, lead(top) over w as top_2 from {d.t('tok')} window w as (partition by doc_id, page_number order by pos)),
 m as (select p.doc_id, p.page_number, p.pos, min(o.top) as min_top, max(o.bottom) as max_bottom from p join {d.t('tok')} o on p.doc_id = o.doc_id and p.page_number = o.page_number and o.top >= p.bottom and o.top < p.top_2 group by p.doc_id, p.page_number, p.pos)
 select p.doc_id, p.page_number, p.pos, cast(p.top_2 - p.top - p.height - coalesce((p.top_2 - m.max_bottom) - (m.min_top - p.top - p.height), 0) as int) as gap from p left join m on p.doc_id = m.doc_id and p.page_number = m.page_number and p.pos = m.pos where p.top_2 is not null"""


@operator("reg", "tok")
def region_type_override(d):
    """Region types corrected by the types of the tokens within."""
    return f"""with k as (select r.doc_id, r.page_number, r.region_seq, count(*) as n, sum(case when t.token_type = 3 then 1 else 0 end) as tables, sum(case when t.token_type = 4 then 1 else 0 end) as pictures
 from {tiled(d, d.t('tok'), d.t('reg'))} and {CLOSED} group by r.doc_id, r.page_number, r.region_seq),
 c as (select r.doc_id, r.page_number, r.region_seq, r.region_type, coalesce(k.n, 0) as n, coalesce(k.tables, 0) as tables, coalesce(k.pictures, 0) as pictures from {d.t('reg')} r left join k on r.doc_id = k.doc_id and r.page_number = k.page_number and r.region_seq = k.region_seq),
 s as (select *, case when n > 0 and cast(tables as double) / n >= 0.15 and tables > pictures and region_type not in ('ScannedPage', 'Formula') then 'Table' else region_type end as step from c)
 select doc_id, page_number, region_seq, case when n > 0 and cast(pictures as double) / n >= 0.15 and pictures > tables and step in ('Table', 'Chart', 'Logo') then 'Figure' else step end as region_type from s""".replace("cast(tables as double) / n", "cast(tables as double) / greatest(n, 1)").replace("cast(pictures as double) / n", "cast(pictures as double) / greatest(n, 1)")


@operator("tok", "font")
def token_font(d):
    """A token's font; nulls where it isn't declared."""
    return f"select t.doc_id, t.page_number, t.pos, f.bold, f.italics, f.font_size, f.color from {d.t('tok')} t left join {d.t('font')} f on t.doc_id = f.doc_id and t.font_id = f.font_id"


@operator("page", "reg")
def table_pages(d):
    """Pages with a table."""
    join = "left semi join" if d.name == "spark" else "semi join"
    return f"select p.doc_id, p.page_number from {d.t('page')} p {join} (select * from {d.t('reg')} where region_type = 'Table') r on p.doc_id = r.doc_id and p.page_number = r.page_number"


@operator("reg", "tok")
def text_in_bbox(d):
    """Text of the tokens that have over a tenth of their area in the region, by left. The region is widened on all sides by a
    twentieth of its longer side, by one at least; one without text or area gives an empty text."""
    pad = f"""greatest(1, {d.idiv('"right" - "left"', '20')}, {d.idiv('bottom - top', '20')})"""
    wide = f"""(select doc_id, page_number, region_seq, "left" - {pad} as "left", top - {pad} as top, "right" + {pad} as "right", bottom + {pad} as bottom from {d.t('reg')} where "right" > "left" and bottom > top)"""
    return f"""with m as (select r.doc_id, r.page_number, r.region_seq, {d.listagg('t.content', "' '", 't."left", t.pos')} as txt from {tiled(d, wide, d.t('tok'), ('r', 't'))} and {OPEN} and t.width * t.height > 0 and {INTER} * 10 > t.width * t.height group by r.doc_id, r.page_number, r.region_seq)
 select r.doc_id, r.page_number, r.region_seq, coalesce(m.txt, '') as txt from {d.t('reg')} r left join m on r.doc_id = m.doc_id and r.page_number = m.page_number and r.region_seq = m.region_seq"""


def _script_line(d, tokens: str = "tok") -> str:
    least_h = "greatest(cast(3 as double), cast(t.height as double) / 2)"
    return f"""{d.t(tokens)} t join {d.t(tokens)} o on t.doc_id = o.doc_id and t.page_number = o.page_number and t.pos <> o.pos and not (o.bottom < t.top + {least_h} or t.bottom - {least_h} < o.top) and o."right" > t."left" * cast(0.7 as double)"""


@operator("tok")
def script_same_line(d):
    """Boxes that share a token's line for super- and subscripts."""
    return f"""select t.doc_id, t.page_number, t.pos, count(*) as n, min(o.top) as top, max(o.bottom) as bottom from {_script_line(d)} group by t.doc_id, t.page_number, t.pos"""


@operator("styled")
def script_type(d):
    """Super- and subscripts: low numbers (of digits of any kind) outside tables, formulas and pictures, by their place on the line that other boxes
    make; alone on a line or beside low boxes they are ordinary text."""
    candidate = f"{d.matches('t.content', f'^{DIGIT}+$')} and t.height < 0.8 * t.common_height and t.token_type not in (3, 0, 4)"
    return f"""with l as (select t.doc_id, t.page_number, t.pos, t.top, t.bottom, t.height, min(o.top) as o_top, max(o.bottom) as o_bottom from {_script_line(d, 'styled')} where {candidate} group by t.doc_id, t.page_number, t.pos, t.top, t.bottom, t.height),
 m as (select *, least(top, o_top) + cast(greatest(bottom, o_bottom) - least(top, o_top) as double) / 2 as middle from l where (o_bottom - o_top) * 0.8 >= height),
 k as (select doc_id, page_number, pos, case when top >= middle then 'sub' when bottom <= middle then 'sup' when abs(top - middle) >= abs(bottom - middle) then 'sup' else 'sub' end as kind from m)
 select t.doc_id, t.page_number, t.pos, case when k.kind is null then t.content else concat('<', k.kind, '>', t.content, '</', k.kind, '>') end as styled from {d.t('styled')} t left join k on t.doc_id = k.doc_id and t.page_number = k.page_number and t.pos = k.pos"""


@operator("img")
def embedded_image_regions(d):
    """Boxes of embedded images; over 60 % of the page: the whole page if it has no text, else nothing."""
    w, h = "(x1 - x0)", "(y1 - y0)"
    big = f"({w} * {h} > 0.6 * page_w * page_h)"
    i = lambda v: d.trunc(v)
    return f"""with b as (select *, least(e, a + e, c + e, a + c + e) as x0, greatest(e, a + e, c + e, a + c + e) as x1, least(page_h - f, page_h - (b + f), page_h - (d + f), page_h - (b + d + f)) as y0, greatest(page_h - f, page_h - (b + f), page_h - (d + f), page_h - (b + d + f)) as y1 from {d.t('img')})
 select doc_id, page_number, seq, case when {big} then 'ScannedPage' else 'Figure' end as region_type, case when {big} then 0 else {i('x0')} end as "left", case when {big} then 0 else {i('y0')} end as top,
 case when {big} then {i('page_w')} else {i(w)} end as width, case when {big} then {i('page_h')} else {i(h)} end as height, case when {big} then {i('page_w * page_h')} else {i(f'{w} * {h}')} end as area from b where not ({big} and has_text)"""


@operator("reg", "img")
def all_regions(d):
    """Embedded images and detected regions of a page, in that order."""
    return f"""select doc_id, page_number, cast(row_number() over (partition by doc_id, page_number order by origin, seq) as int) as n, origin, seq from (
 select doc_id, page_number, 0 as origin, seq from {d.t('img')} union all select doc_id, page_number, 1 as origin, region_seq as seq from {d.t('reg')}) u"""


@operator("tok")
def prediction_rows(d):
    return f"""select page_number, "left", top, "right", bottom, content as text_content, {DISPLAY} as token_type, doc_id from {d.t('tok')}"""


assert len(TOKEN_TYPES) == 11
