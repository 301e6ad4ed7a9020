"""Sequences on a page: contexts, windows, decoding, lines, blocks and the Markdown made from them.

Folds whose state depends on what was decided before (lines, blocks) are expressions over an array of a page's rows, so what is
dealt by document stays where it is. Decoding is in decoding.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dual import operator
from ..plans.fixtures import DISPLAY, FX
from .decoding import viterbi
from .joins import LINE_JOIN, PLACED, _table_md

PAGE = "doc_id, page_number"
#: A gap over which a paragraph ends; half of it where the type changes.
PARAGRAPH_GAP = 12
#: Characters that mark a list item.
LIST_MARKERS = ("-", "•", "\uf0b7", "‣", "⁃", "⁌", "⁍", "◘", "◦", "⦾", "⦿")


def _token_context(tok: DataFrame) -> DataFrame:
    from .sweep import CONTEXTS, KEY, sweep

    return sweep(tok).select(*KEY, *CONTEXTS)


@operator("tok", spark=_token_context)
def token_context(d):
    """Edges of the neighbours on a token's line: nearest and farthest to the left and to the right, 0 without any."""
    left, right = 'o."right" < t."right"', 't."left" < o."left"'
    pick = lambda f, c, v: f"coalesce({f}(case when {c} then {v} end), 0)"
    return f"""select t.doc_id, t.page_number, t.pos, {pick('max', left, 'o."right"')} as right_of_token_on_the_left, {pick('min', left, 'o."left"')} as left_of_token_on_the_left,
 {pick('min', right, 'o."left"')} as left_of_token_on_the_right, {pick('max', right, 'o."right"')} as right_of_token_on_the_right from {d.t('tok')} t join {d.t('tok')} o on {LINE_JOIN} group by t.doc_id, t.page_number, t.pos"""


def _padded(d) -> str:
    """Tokens of a page with four padding tokens before and after; position 1 is the first padding."""
    pads = ", ".join(f"({i})" for i in range(1, 5))
    pad = lambda at: f"""select {PAGE}, {at} as k, 0 as pos, true as pad, -1 as "left", -1 as top, 1 as "right", 1 as bottom, 2 as width, 2 as height from n cross join (values {pads}) v(i)"""
    return f"""n as (select {PAGE}, cast(max(pos) as int) as n from {d.t('tok')} group by {PAGE}),
 padded as (select {PAGE}, pos + 4 as k, pos, false as pad, "left", top, "right", bottom, width, height from {d.t('tok')} union all {pad('i')} union all {pad('n.n + 4 + i')})"""


@operator("tok")
def token_pairs(d):
    """Consecutive tokens of a padded page."""
    return f"""with {_padded(d)} select * from (select {PAGE}, k, pos, lead(pos) over w as next_pos, (lead("left") over w) - "left" - width as gap, (lead(top) over w) - top as drop_ from padded window w as (partition by {PAGE} order by k)) x where next_pos is not null"""


@operator("tok")
def context_window(d):
    """For each token the eight pairs around it, here by the horizontal gap of each pair."""
    w = f"partition by {PAGE} order by k rows between 4 preceding and 3 following"
    collect = f"collect_list(gap) over ({w})" if d.name == "spark" else f"list(gap) over ({w})"
    joined = f"array_join(transform(gaps, g -> cast(g as string)), ',')" if d.name == "spark" else "array_to_string(gaps, ',')"  # noqa: F541
    return f"""with {_padded(d)}, pairs as (select * from (select {PAGE}, k, pos, pad, (lead("left") over w) - "left" - width as gap, lead(k) over w as next_k from padded window w as (partition by {PAGE} order by k)) x where next_k is not null),
 windows as (select {PAGE}, pos, pad, {collect} as gaps from pairs) select {PAGE}, pos, {joined} as gaps from windows where not pad"""


@operator("ord")
def reading_order_features(d):
    """Gap, percentiles, adjacency and numbers in reading order of a token and the next; percentiles by the page's first and
    last token in list order."""
    r = "cast(greatest(last_ro - first_ro, 1) as double)"
    return f"""select {PAGE}, pos, cast(r2 - r1 as double) / n as gap_norm, (r1 - first_ro) / {r} as percentile_1, (r2 - first_ro) / {r} as percentile_2, case when abs(r2 - r1) <= 2 then 1 else 0 end as adjacent, r1, r2 from (
 select {PAGE}, pos, reading_order_no as r1, lead(reading_order_no) over (partition by {PAGE} order by pos) as r2, first_value(reading_order_no) over u as first_ro, last_value(reading_order_no) over u as last_ro, count(*) over u as n
 from {d.t('ord')} window u as (partition by {PAGE} order by pos rows between unbounded preceding and unbounded following)) x where r2 is not null"""


@operator("listed")
def list_levels(d):
    """List level: the place of a content's first character, blanks aside, among the markers in the order in which a document
    first has them, at most 3; -1 without a marker."""
    marks = ", ".join(f"'{m}'" for m in LIST_MARKERS)
    return f"""with c as (select {PAGE}, pos, substr({d.lstrip('content')}, 1, 1) as marker from {d.t('listed')}),
 f as (select doc_id, marker, row_number() over (partition by doc_id order by min(page_number * cast(1000000 as bigint) + pos)) - 1 as level from c where marker in ({marks}) group by doc_id, marker)
 select c.doc_id, c.page_number, c.pos, cast(case when f.level is null then -1 when f.level > 3 then 3 else f.level end as int) as level from c left join f on f.doc_id = c.doc_id and f.marker = c.marker"""


FX.add("leveled", "listed")(lambda d: f"select l.doc_id, l.page_number, l.pos, t.content, l.level from ({list_levels.template(d)}) l join {d.t('listed')} t on l.doc_id = t.doc_id and l.page_number = t.page_number and l.pos = t.pos")


def _page_arrays(df: DataFrame, order: str, *others: str) -> DataFrame:
    """doc_id, page_number, rows: the columns named of a page's rows, in order."""
    return df.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("rows"))


def _lines_spark(tok: DataFrame) -> DataFrame:
    """Pivots of a page one after another, then each token's: the first that it overlaps vertically."""
    box = [F.col(c).cast("int").alias(c) for c in ("pos", "top", "bottom")]
    meets = "filter(pivots, q -> q.bottom >= t.top and t.bottom >= q.top)"
    folded = f"""aggregate(rows, cast(array() as array<struct<pos: int, top: int, bottom: int>>), (pivots, t) -> if(size({meets}) > 0, pivots, concat(pivots, array(t))),
 pivots -> transform(rows, t -> named_struct('pos', t.pos, 'line_id', {meets}[0].pos)))"""
    return _page_arrays(tok.select("doc_id", "page_number", *box), "pos", "top", "bottom").selectExpr("doc_id", "page_number", f"inline({folded})")


@FX.add("lineof", "tok", spark=_lines_spark)
def lineof(d):
    """line_id of each token: the first pivot that it overlaps vertically; a token that overlaps no earlier pivot is one."""
    return f"""with recursive pa as (select {PAGE}, list({{'pos': pos, 'top': top, 'bottom': bottom}} order by pos) ts from tok group by {PAGE}),
pr as (select {PAGE}, ts, 1 as i, [ts[1]] as pv from pa union all
 select {PAGE}, ts, i + 1, case when len(list_filter(pv, lambda q: not(q.bottom < ts[i+1].top or ts[i+1].bottom < q.top))) > 0 then pv else list_append(pv, ts[i+1]) end from pr where i < len(ts)),
pp as (select {PAGE}, ts, pv from pr where i = len(ts)),
pe as (select {PAGE}, pv, unnest(ts) t from pp)
select {PAGE}, t.pos as pos, (list_filter(pv, lambda q: not(q.bottom < t.top or t.bottom < q.top))[1]).pos as line_id from pe"""


@operator("lineof")
def token_lines(d):
    return f"select doc_id, page_number, pos, line_id from {d.t('lineof')}"


@FX.add("typed", "tok", "emi")
def typed(d):
    """Tokens with the likeliest type."""
    at = "array_position(e.p, array_max(e.p))" if d.name == "spark" else "list_position(e.p, list_max(e.p))"
    return f"""select t.doc_id, t.page_number, t.pos, t.content, t."left", t.top, t."right", t.bottom, cast({at} - 1 as int) as token_type from {d.t('tok')} t join {d.t('emi')} e on t.doc_id = e.doc_id and t.page_number = e.page_number and t.pos = e.pos"""


@FX.add("lines", "typed", "lineof")
def lines(d):
    x = f"""(select t.*, p.line_id, count(*) over (partition by t.doc_id, t.page_number, p.line_id, t.token_type) as same, row_number() over (partition by t.doc_id, t.page_number, p.line_id order by t."left", t.pos) as seat
  from {d.t('typed')} t join {d.t('lineof')} p on t.doc_id = p.doc_id and t.page_number = p.page_number and t.pos = p.pos) x"""
    return f"""select {PAGE}, line_id, min(top) as top, max(bottom) as bottom, min("left") as "left", max("right") as "right", {d.listagg('content', "' '", '"left", pos')} as txt, min(case when best = 1 then token_type end) as dominant_type,
 cast(row_number() over (partition by {PAGE} order by min(top), line_id) as int) as line_no from (select *, row_number() over (partition by {PAGE}, line_id order by same desc, seat) as best from {x}) y group by {PAGE}, line_id"""


@operator("lines")
def line_dominant_type(d):
    """A line's commonest type, the leftmost on ties."""
    return f"select doc_id, page_number, line_id, dominant_type from {d.t('lines')}"


@FX.add("elems", "lines", "reg")
def elems(d):
    """Lines and placed regions of a page in order: a region stands before the first line that ends at or below its top. Spark deals
    the two together by document, once for all that follows."""
    dealt = " distribute by doc_id" if d.name == "spark" else ""
    return f"""with r as (select r.doc_id, r.page_number, r.region_seq, r.top, r.bottom, r.region_type, coalesce(min(l.line_no), 1000000) as before_line from (select * from {d.t('reg')} where region_type in {PLACED}) r
  left join {d.t('lines')} l on r.doc_id = l.doc_id and r.page_number = l.page_number and l.bottom >= r.top group by r.doc_id, r.page_number, r.region_seq, r.top, r.bottom, r.region_type),
 u as (select {PAGE}, line_no, 1 as is_line, 0 as r_top, 0 as region_seq, top, bottom, dominant_type as etype, txt from {d.t('lines')}
  union all select {PAGE}, before_line as line_no, 0 as is_line, top as r_top, region_seq, top, bottom, case when region_type = 'Table' then 3 else 4 end as etype, '' as txt from r),
 e as (select * from u{dealt})
 select {PAGE}, cast(row_number() over (partition by {PAGE} order by line_no, is_line, r_top, region_seq) as int) as ord, is_line = 0 as is_region, case when is_line = 0 then region_seq end as region_seq, top, bottom, etype, txt from e"""


@operator("elems")
def insert_regions(d):
    return f"select doc_id, page_number, ord, is_region, region_seq, top, etype from {d.t('elems')}"


def fold_blocks(is_region: np.ndarray, etype: np.ndarray, top: np.ndarray, bottom: np.ndarray, first: np.ndarray) -> tuple[list[int], list[int]]:
    """Block number (within a page) and type of each element; `first` marks the first element of a page. The
    plain walk beside which tests hold Spark's form."""
    blocks, types = [], []
    block, kind, opened, last = 0, 6, False, 0
    for region, t, y0, y1, new in zip(is_region.tolist(), etype.tolist(), top.tolist(), bottom.tolist(), first.tolist(), strict=True):
        if new:
            block, opened = 0, False
        gap = y0 - last
        if region or not opened or t in (5, 8) or kind in (5, 8) or gap > PARAGRAPH_GAP or (t != kind and 2 * gap > PARAGRAPH_GAP):
            block, kind = block + 1, t
        opened, last = not region, y1
        blocks.append(block)
        types.append(kind)
    return blocks, types


def _blocks_spark(elems: DataFrame) -> DataFrame:
    start = f"e.is_region or not s.opened or e.etype in (5, 8) or s.kind in (5, 8) or e.top - s.last > {PARAGRAPH_GAP} or (e.etype <> s.kind and 2 * (e.top - s.last) > {PARAGRAPH_GAP})"
    step = """named_struct('block', s.block + b.new, 'kind', if(b.new = 1, e.etype, s.kind), 'opened', not e.is_region, 'last', e.bottom,
 'out', concat(s.out, array(named_struct('block_no', s.block + b.new, 'block_type', if(b.new = 1, e.etype, s.kind)))))"""
    zero = "named_struct('block', 0, 'kind', 6, 'opened', false, 'last', 0, 'out', cast(array() as array<struct<block_no: int, block_type: int>>))"
    folded = f"aggregate(rows, {zero}, (s, e) -> transform(array(named_struct('new', if({start}, 1, 0))), b -> {step})[0], s -> s.out)"
    pages = _page_arrays(elems, "ord", "is_region", "region_seq", "txt", "etype", "top", "bottom").select("doc_id", "page_number", F.inline(F.arrays_zip("rows", F.expr(folded).alias("made"))))
    return pages.selectExpr("doc_id", "page_number", "rows.ord", "rows.is_region", "rows.region_seq", "rows.txt", "rows.etype", "made.block_no", "made.block_type")


@FX.add("blocks", "elems", spark=_blocks_spark)
def blocks(d):
    start = "e.is_region or not r.opened or e.etype in (5, 8) or r.block_type in (5, 8) or e.top - r.last > 12 or (e.etype <> r.block_type and 2 * (e.top - r.last) > 12)"
    return f"""with recursive fold as (select {PAGE}, ord, is_region, region_seq, txt, etype, 1 as block_no, etype as block_type, not is_region as opened, bottom as last from elems where ord = 1
 union all select e.doc_id, e.page_number, e.ord, e.is_region, e.region_seq, e.txt, e.etype, case when {start} then r.block_no + 1 else r.block_no end, case when {start} then e.etype else r.block_type end, not e.is_region, e.bottom
 from fold r join elems e on r.doc_id = e.doc_id and r.page_number = e.page_number and e.ord = r.ord + 1)
 select {PAGE}, ord, is_region, region_seq, txt, etype, block_no, block_type from fold"""


@operator("blocks")
def line_blocks(d):
    """Lines and regions grouped into blocks."""
    return f"select doc_id, page_number, ord, block_no, block_type from {d.t('blocks')}"


@FX.add("tables", "cell", "tok")
def tables(d):
    return f"with {_table_md(d)} select doc_id, page_number, region_seq, md from tables"


@FX.add("block_md", "blocks", "reg", "tables")
def block_md(d):
    nl = d.newline
    text = d.listagg("txt", "' '", "ord")
    items = d.listagg("concat('- ', txt)", nl, "ord")
    picture = f"""concat('<!-- ', r.region_type, ' at (', r."left", ',', r.top, ') ', r.width, 'x', r.height, ' -->', {nl}, {nl}, '[', r.region_type, ' p', r.page_number, '](image_page', r.page_number, '_', r."left", '_', r.top, '.png)')"""
    return f"""with b as (select {PAGE}, block_no, block_type, bool_or(is_region) as is_region, max(region_seq) as region_seq, {text} as txt, {items} as items from {d.t('blocks')} group by {PAGE}, block_no, block_type)
 select b.doc_id, b.page_number, b.block_no, b.block_type, case when b.is_region and b.block_type = 3 then coalesce(t.md, concat('<!-- Table detected but no TSR data -->', {nl}, {nl})) when b.is_region then {picture}
  when b.block_type in (3, 4) then '' when b.block_type = 5 then concat('# ', b.txt) when b.block_type = 8 then concat('## ', b.txt) when b.block_type = 2 then b.items when b.block_type = 9 then concat('*', b.txt, '*')
  when b.block_type = 0 then concat('$$', {nl}, b.txt, {nl}, '$$') when b.block_type = 1 then concat('[^note]: ', b.txt) when b.block_type = 7 then concat('<!-- Page header: ', b.txt, ' -->') when b.block_type = 10 then concat('<!-- Page footer: ', b.txt, ' -->') else b.txt end as md
 from b left join {d.t('reg')} r on b.is_region and b.doc_id = r.doc_id and b.page_number = r.page_number and b.region_seq = r.region_seq
 left join {d.t('tables')} t on b.is_region and b.doc_id = t.doc_id and b.page_number = t.page_number and b.region_seq = t.region_seq"""


@operator("block_md")
def block_markdown(d):
    """Markdown of each block; text that is typed as table or picture gives nothing."""
    return f"select doc_id, page_number, block_no, block_type, md from {d.t('block_md')}"


@operator("block_md")
def page_markdown(d):
    return f"""select doc_id, page_number, {d.listagg('md', f'concat({d.newline}, {d.newline})', 'block_no')} as md from {d.t('block_md')} where md <> '' group by doc_id, page_number"""


@operator("block_md")
def document_markdown(d):
    """A document's Markdown: its non-blank pages, each its non-empty blocks."""
    two = f"concat({d.newline}, {d.newline})"
    return f"""select doc_id, {d.listagg('md', two, 'page_number')} as md from (select doc_id, page_number, {d.listagg('md', two, 'block_no')} as md from {d.t('block_md')} where md <> '' group by doc_id, page_number) p where length(trim(md)) > 0 group by doc_id"""


@FX.add("trans", "tok")
def trans(d):
    from .aggregates import transition_matrix

    return transition_matrix.template(d)


@operator("emi", "trans", spark=viterbi)
def viterbi_labels(d):
    """Types of a page's tokens as the likeliest sequence under the transition matrix, scores in multiples of 2**-32."""
    return """with recursive lt as (select list(cast(round(ln(p + 1e-12) * 4294967296) as bigint) order by prev, curr) as m from trans),
 le as (select doc_id, page_number, pos, list_transform(p, lambda x: cast(round(ln(x + 1e-12) * 4294967296) as bigint)) as e, p from emi),
 last as (select doc_id, page_number, max(pos) as n from emi group by doc_id, page_number),
 f as (select doc_id, page_number, pos, e as best, list_transform(range(11), lambda j: [j]) as paths from le where pos = 1
  union all select doc_id, page_number, pos, list_transform(b, lambda x: x.s), list_transform(b, lambda x: list_append(paths[x.k], x.j)) from (
   select f.doc_id, f.page_number, le.pos, f.paths, list_transform(range(11), lambda j: {'s': list_max(list_transform(range(11), lambda k: f.best[k+1] + lt.m[k*11+j+1] + le.e[j+1])),
    'k': list_position(list_transform(range(11), lambda k: f.best[k+1] + lt.m[k*11+j+1] + le.e[j+1]), list_max(list_transform(range(11), lambda k: f.best[k+1] + lt.m[k*11+j+1] + le.e[j+1]))), 'j': j}) as b
   from f join le on le.doc_id = f.doc_id and le.page_number = f.page_number and le.pos = f.pos + 1 cross join lt) s),
 done as (select f.doc_id, f.page_number, f.paths[list_position(f.best, list_max(f.best))] as path from f join last on f.doc_id = last.doc_id and f.page_number = last.page_number and f.pos = last.n)
 select doc_id, page_number, cast(unnest(range(1, len(path) + 1)) as int) as pos, cast(unnest(path) as int) as label from done"""


assert DISPLAY and F
