"""Aggregations. Modes and medians take the first value seen on ties, so positions are part of every order."""

from __future__ import annotations

from ..plans.dual import operator, rendered
from .joins import LINE_JOIN
from .sweep import sweep

PAGE = "doc_id, page_number"


def line_ends(d) -> str:
    """(doc_id, page_number, pos, v): right edges of the last tokens of lines."""
    return f"""select t.doc_id, t.page_number, t.pos, t."right" as v from {d.t('tok')} t join {d.t('tok')} o on {LINE_JOIN} group by t.doc_id, t.page_number, t.pos, t."right" having sum(case when o."left" > t."right" then 1 else 0 end) = 0"""


def modes(d) -> str:
    """doc_modes from the relation `sweep`."""
    return _modes(d, f"select doc_id, page_number, pos, below as v from {d.t('sweep')} where below is not null", f"select doc_id, page_number, pos, end_right as v from {d.t('sweep')} where end_right is not null")


@operator("tok", "page", spark=lambda tok, page: rendered(modes, {"sweep": sweep(tok), "page": page}))
def doc_modes(d):
    """Modes of the gaps to the token below and of the right edges of a line's last tokens; both lists begin with 0."""
    below = f"""select t.doc_id, t.page_number, t.pos, min(o.top) - t.bottom as v from {d.t('tok')} t join (select distinct doc_id, page_number, top from {d.t('tok')}) o on t.doc_id = o.doc_id and t.page_number = o.page_number and o.top > t.bottom group by t.doc_id, t.page_number, t.pos, t.bottom"""
    return _modes(d, below, line_ends(d))


def _modes(d, gaps: str, ends: str) -> str:
    return f"""with gaps as ({gaps}), ends as ({ends}),
 docs as (select doc_id, min(page_number) as first_page from {d.t('page')} group by doc_id),
 g as (select doc_id, 0 as page_number, 0 as pos, 0 as v from docs union all select doc_id, page_number, pos, v from gaps),
 r as (select doc_id, 0 as page_number, 0 as pos, 0 as v from docs union all select doc_id, page_number, pos, v from ends),
 gm as (select doc_id, v, row_number() over (partition by doc_id order by n desc, p) as rn from (select doc_id, v, count(*) as n, min(page_number * 1000000 + pos) as p from g group by doc_id, v) x),
 rm as (select doc_id, v, row_number() over (partition by doc_id order by n desc, p) as rn from (select doc_id, v, count(*) as n, min(page_number * 1000000 + pos) as p from r group by doc_id, v) x)
 select docs.doc_id, cast(gm.v as int) as lines_space_mode, cast(p.page_width - rm.v as int) as right_space_mode from docs join gm on docs.doc_id = gm.doc_id and gm.rn = 1 join rm on docs.doc_id = rm.doc_id and rm.rn = 1
 join {d.t('page')} p on p.doc_id = docs.doc_id and p.page_number = docs.first_page"""


@operator("tok", "font")
def font_mode(d):
    """The commonest font of a document, the first seen on ties, and its size."""
    return f"""select x.doc_id, x.font_id, f.font_size as font_size_mode from (select doc_id, font_id, row_number() over (partition by doc_id order by n desc, p) as rn from (
 select doc_id, font_id, count(*) as n, min(page_number * 1000000 + pos) as p from {d.t('tok')} group by doc_id, font_id) a) x join {d.t('font')} f on x.doc_id = f.doc_id and x.font_id = f.font_id where rn = 1"""


@operator("tok", "font")
def body_font_size(d):
    """Upper median of the sizes of Text tokens, 10 without any."""
    return f"""with s as (select t.doc_id, f.font_size, row_number() over (partition by t.doc_id order by f.font_size) - 1 as rn, count(*) over (partition by t.doc_id) as n from {d.t('tok')} t join {d.t('font')} f on t.doc_id = f.doc_id and t.font_id = f.font_id where t.token_type = 6 and f.font_size > 0)
 select a.doc_id, coalesce(s.font_size, cast(10 as double)) as body_font_size from (select distinct doc_id from {d.t('tok')}) a left join s on a.doc_id = s.doc_id and s.rn = {d.idiv('s.n', '2')}"""


@operator("frag")
def merge_rectangles(d):
    """Box around a line's fragments."""
    return f"""select {PAGE}, line_no, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom, max("right") - min("left") as width, max(bottom) - min(top) as height from {d.t('frag')} group by {PAGE}, line_no"""


@operator("frag")
def merge_tokens(d):
    """A line's fragments as one token: joined text, box around, type of the first."""
    return f"""select m.doc_id, m.page_number, m.line_no, m.txt, m."left", m.top, m."right", m.bottom, f.token_type from (select {PAGE}, line_no, {d.listagg('content', "' '", 'frag_no')} as txt, min("left") as "left", min(top) as top, max("right") as "right", max(bottom) as bottom, min(frag_no) as first_frag from {d.t('frag')} group by {PAGE}, line_no) m
 join {d.t('frag')} f on f.doc_id = m.doc_id and f.page_number = m.page_number and f.line_no = m.line_no and f.frag_no = m.first_frag"""


@operator("tok")
def page_globals(d):
    """Extent of a page's tokens, at least 1 each way, and their number over 2000, at most 1."""
    return f"""select {PAGE}, min("left") as page_left, min(top) as page_top, greatest(max("right") - min("left"), 1) as extent_x, greatest(max(bottom) - min(top), 1) as extent_y, least(cast(count(*) as double) / 2000, cast(1 as double)) as count_norm from {d.t('tok')} group by {PAGE}"""


@operator("tok")
def transition_matrix(d):
    """Probability of each type after each other on a page in document order, every count begun at one."""
    types = ", ".join(f"({i})" for i in range(11))
    return f"""with n as (select prev, curr, count(*) as c from (select lag(token_type) over (partition by {PAGE} order by pos) as prev, token_type as curr from {d.t('tok')}) x where prev is not null group by prev, curr),
 g as (select a.i as prev, b.i as curr from (values {types}) a(i) cross join (values {types}) b(i)),
 m as (select g.prev, g.curr, 1 + coalesce(n.c, 0) as c from g left join n on g.prev = n.prev and g.curr = n.curr)
 select prev, curr, cast(c as double) / cast(sum(c) over (partition by prev) as double) as p from m"""


@operator("tok", "reg")
def document_counts(d):
    return f"""select p.doc_id, p.num_pages, p.num_tokens, r.num_regions from (select doc_id, count(distinct page_number) as num_pages, count(*) as num_tokens from {d.t('tok')} group by doc_id) p join (select doc_id, count(*) as num_regions from {d.t('reg')} group by doc_id) r on p.doc_id = r.doc_id"""


@operator("guess")
def all_correct(d):
    """Whether a document's predictions are all right."""
    return f"""select doc_id, bool_and(token_type = predicted_type) as correct from {d.t('guess')} group by doc_id"""


@operator("emi")
def argmax_labels(d):
    """The likeliest type of a token, the first on ties."""
    if d.name == "spark":
        return f"select doc_id, page_number, pos, cast(array_position(p, array_max(p)) - 1 as int) as label from {d.t('emi')}"
    return "select doc_id, page_number, pos, cast(list_position(p, list_max(p)) - 1 as int) as label from emi"


def _tsr_rows(d) -> str:
    """CTEs up to rows_(…, row): boxes in rows from top to bottom; a last row of one box is lost, as it never ends."""
    key = "doc_id, page_number, region_seq"
    if d.name == "spark":  # windows over tables alone, so all of it is one exchange
        kept = f"""kept as (select * from (select *, cast(sum(h) over (partition by {key}) as double) / count(*) over (partition by {key}) as mean_h from {d.t('box')}) b where b.w < 0.9 * b.img_w and b.h < 0.9 * b.img_h)"""
    else:
        kept = _tsr_kept(d)
    return f"""{kept},
 islands as (select *, sum(starts) over (partition by {key} order by y, seq rows between unbounded preceding and current row) - 1 as row_no from (select *, case when lag(y) over (partition by {key} order by y, seq) is null or y > lag(y) over (partition by {key} order by y, seq) + mean_h / 2 then 1 else 0 end as starts from kept) x),
 sized as (select *, count(*) over (partition by {key}, row_no) as n, max(row_no) over (partition by {key}) as last_row from islands),
 rows_ as (select {key}, seq, x, y, w, h, cast(row_no as int) as row_no, n from sized where not (row_no = last_row and n = 1))"""


def _tsr_kept(d) -> str:
    key = "doc_id, page_number, region_seq"
    return f"""mean as (select {key}, cast(sum(h) as double) / count(*) as mean_h from {d.t('box')} group by {key}),
 kept as (select b.*, m.mean_h from {d.t('box')} b join mean m on b.doc_id = m.doc_id and b.page_number = m.page_number and b.region_seq = m.region_seq where b.w < 0.9 * b.img_w and b.h < 0.9 * b.img_h)"""


@operator("box")
def tsr_rows(d):
    """Rows of a table's boxes."""
    return f"with {_tsr_rows(d)} select doc_id, page_number, region_seq, seq, row_no from rows_"


def _tsr_columns(d) -> str:
    key = "doc_id, page_number, region_seq"
    if d.name == "spark":  # a table's centres as an array beside each of its boxes
        return f"""{_tsr_rows(d)},
 ranked as (select *, {d.trunc('x + cast(w as double) / 2')} as center, first_value(row_no) over (partition by {key} order by n desc, row_no) as widest from rows_),
 centers as (select {key}, center, cast(row_number() over (partition by {key} order by center, seq) - 1 as int) as col from ranked where row_no = widest),
 beside as (select *, transform(array_sort(collect_list(case when row_no = widest then struct(center, seq) end) over (partition by {key})), c -> c.center) as cs from ranked),
 assigned as (select {key}, seq, x, y, w, h, row_no, n, array_min(transform(cs, (c, i) -> struct(abs(c - (x + cast(w as double) / 4)) as far, i as i))).i as col from beside)"""
    return f"""{_tsr_rows(d)},
 widest as (select {key}, row_no from (select {key}, row_no, row_number() over (partition by {key} order by max(n) desc, row_no) as rn from rows_ group by {key}, row_no) x where rn = 1),
 centers as (select r.doc_id, r.page_number, r.region_seq, {d.trunc('r.x + cast(r.w as double) / 2')} as center, cast(row_number() over (partition by r.doc_id, r.page_number, r.region_seq order by {d.trunc('r.x + cast(r.w as double) / 2')}, r.seq) - 1 as int) as col from rows_ r join widest k on r.doc_id = k.doc_id and r.page_number = k.page_number and r.region_seq = k.region_seq and r.row_no = k.row_no),
 assigned as (select * from (select r.*, c.col, row_number() over (partition by r.doc_id, r.page_number, r.region_seq, r.seq order by abs(c.center - (r.x + cast(r.w as double) / 4)), c.col) as nearest from rows_ r join centers c on r.doc_id = c.doc_id and r.page_number = c.page_number and r.region_seq = c.region_seq) x where nearest = 1)"""


@operator("box")
def tsr_column_centers(d):
    """Column centres, from the first of the rows with most boxes."""
    return f"with {_tsr_columns(d)} select doc_id, page_number, region_seq, col, center from centers"


@operator("box")
def tsr_column_assign(d):
    """Each box's column: the nearest centre to a quarter of its width, the first on ties."""
    return f"with {_tsr_columns(d)} select doc_id, page_number, region_seq, seq, row_no, col from assigned"


@operator("box")
def tsr_first_box(d):
    """The first box, from the left, of each cell of the grid, as XML puts it down."""
    return f"""with {_tsr_columns(d)} select doc_id, page_number, region_seq, row_no, col, x, y, w, h from (select *, row_number() over (partition by doc_id, page_number, region_seq, row_no, col order by y, seq) as rn from assigned) z where rn = 1"""


@operator("box")
def tsr_xml(d):
    """A table's grid as XML: of each cell of the grid that has boxes the first; an empty element without any."""
    key, q = "doc_id, page_number, region_seq", "chr(34)"
    pair = lambda n, v: f"' {n}=', {q}, {v}, {q}"
    cell = f"""concat('  <cell', {pair('row', 'row_no')}, {pair('column', 'col')}, '>', {d.newline}, '    <boundingbox', {pair('x', 'x')}, {pair('y', 'y')}, {pair('w', 'w')}, {pair('h', 'h')}, '/>', {d.newline}, '  </cell>', {d.newline})"""
    return f"""with f as ({tsr_first_box.template(d)}), g as (select {key}, {d.listagg(cell, "''", 'row_no, col')} as cells from f group by {key})
 select b.doc_id, b.page_number, b.region_seq, case when g.cells is null then concat('<table/>', {d.newline}) else concat('<table>', {d.newline}, g.cells, '</table>', {d.newline}) end as xml
 from (select distinct {key} from {d.t('box')}) b left join g on b.doc_id = g.doc_id and b.page_number = g.page_number and b.region_seq = g.region_seq"""
