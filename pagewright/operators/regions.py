"""Region types, rendering of regions and styles, and documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dual import braced, operator, rendered
from ..plans.fixtures import FX, TOKEN_TYPES

PAGE = "doc_id, page_number"


@operator("reg")
def classify_regions(d):
    """Region type by the first rule that holds."""
    return f"""select doc_id, page_number, region_seq, case when region_type in ('ScannedPage', 'Figure') then region_type when fill_density <= 0.90 and h_lines >= 3 and v_lines >= 3 then 'Table'
 when color_variance > 500 and edge_density > 0.03 then 'Photo' when edge_density > 0.03 and fill_density < 0.4 then 'Chart' when edge_density > 0.10 then 'Chart'
 when color_variance <= 500 and edge_density <= 0.03 and aspect_ratio > 1.0 then 'Logo' when aspect_ratio < 0.8 and color_variance <= 500 and edge_density > 0.03 then 'Formula' else 'Figure' end as region_type from {d.t('reg')}"""


@operator("cropped")
def picture_markdown(d):
    """A picture block in the three modes; without a crop, embedding falls back to a link."""
    nl = d.newline
    name = """concat('image_page', page_number, '_', "left", '_', top, '.png')"""
    alt = "concat(region_type, ' p', page_number)"
    return f"""select doc_id, page_number, region_seq, concat('<!-- ', region_type, ' at (', "left", ',', top, ') ', width, 'x', height, ' -->', {nl}, {nl}, '[', {alt}, '](', {name}, ')') as placeholder,
 concat('![', {alt}, '](images/', {name}, ')') as url, case when crop is not null then concat('![', {alt}, '](data:image/png;base64,', base64(crop), ')') else concat('[', {alt}, '](', {name}, ')') end as embed
 from {d.t('cropped')} where region_type in ('Picture', 'Photo', 'Figure', 'Chart')"""


def _xml_cells_spark(structure: DataFrame) -> DataFrame:
    schema = "cell array<struct<_row: int, _column: int, boundingbox: struct<_x: double, _y: double, _w: double, _h: double>>>"
    read = F.from_xml("xml", schema, {"rowTag": "table", "mode": "PERMISSIVE"})
    cells = structure.where("readable and xml <> ''").select("doc_id", "page_number", "left", "top", "tsr_seq", F.posexplode(read["cell"]).alias("n", "c")).where("c.boundingbox is not null")
    number = lambda name: F.coalesce(f"c.{name}", F.lit(0)).alias(name.rpartition("_")[2])
    place = [number("_row").alias("row"), number("_column").alias("col")]
    return cells.select("doc_id", "page_number", "left", "top", "tsr_seq", "n", *place, *[number(f"boundingbox._{c}") for c in "xywh"])


@operator("structure", spark=_xml_cells_spark)
def xml_cells(d):
    """Cells of a structure's XML that have a box, in order; what an attribute doesn't say is 0. Spark's form reads any XML, this
    text that of the relation alone."""
    at = lambda name: f"coalesce(try_cast(regexp_extract(c, ' {name}=.([-0-9.]+)', 1) as double), 0)"
    return f"""with c as (select doc_id, page_number, "left", top, tsr_seq, unnest(range(len(regexp_extract_all(xml, '<cell.*?</cell>'))))::int as n, unnest(regexp_extract_all(xml, '<cell.*?</cell>')) as c from structure where readable and xml <> '')
 select doc_id, page_number, "left", top, tsr_seq, n, cast({at('row')} as int) as "row", cast({at('column')} as int) as col, {at('x')} as x, {at('y')} as y, {at('w')} as w, {at('h')} as h from c where contains(c, '<boundingbox')"""


FX.add("xmlcell", "structure", spark=_xml_cells_spark)(xml_cells.template)


@operator("xmlcell")
def cells_in_points(d):
    """Cells of recognised structures, from the pixels of a crop at 150 dpi to points."""
    s = "(cast(150 as double) / 72)"
    return f"""select doc_id, page_number, "left", top, tsr_seq, n, "row", col, x / {s} as x, y / {s} as y, w / {s} as w, h / {s} as h from {d.t('xmlcell')}"""


def _last_structure(d) -> str:
    return f"""(select * from (select *, row_number() over (partition by doc_id, page_number, "left", top order by tsr_seq desc) as rn from {d.t('structure')}) x where rn = 1)"""


@operator("reg", "structure", "xmlcell")
def table_fallback(d):
    """What stands for a table without structure or, of the last structure at its corner, without cells and without XML, with XML
    that can't be read or that has no cell; else nothing."""
    nl = d.newline
    note = lambda text: f"concat('<!-- {text} -->', {nl}, {nl})"
    return f"""select r.doc_id, r.page_number, r.region_seq, case when t.tsr_seq is null then {note('Table detected but no TSR data')} when t.num_cells > 0 then '' when coalesce(t.xml, '') = '' then {note('Table: no XML')} when not t.readable then {note('Table: invalid XML')} when k.n is null then {note('Table: no cells')} else '' end as md
 from (select * from {d.t('reg')} where region_type = 'Table') r left join {_last_structure(d)} t on r.doc_id = t.doc_id and r.page_number = t.page_number and r."left" = t."left" and r.top = t.top
 left join (select doc_id, page_number, "left", top, tsr_seq, count(*) as n from {d.t('xmlcell')} group by doc_id, page_number, "left", top, tsr_seq) k on t.doc_id = k.doc_id and t.page_number = k.page_number and t."left" = k."left" and t.top = k.top and t.tsr_seq = k.tsr_seq"""


def _xml_table_cells(d) -> str:
    """Cells of tables whose last structure has none but XML with cells, with the corner of their region."""
    return f"""select r.doc_id, r.page_number, r.region_seq, r."left" as region_left, r.top as region_top, k."row", k.col, k.x, k.y, k.w, k.h
  from (select * from {d.t('reg')} where region_type = 'Table') r join {_last_structure(d)} t on r.doc_id = t.doc_id and r.page_number = t.page_number and r."left" = t."left" and r.top = t.top and t.num_cells = 0
  join {d.t('xmlcell')} k on t.doc_id = k.doc_id and t.page_number = k.page_number and t."left" = k."left" and t.top = k.top and t.tsr_seq = k.tsr_seq"""


FX.add("xmltable", "reg", "structure", "xmlcell")(_xml_table_cells)


def _xml_table_md(xmltable: DataFrame, tok: DataFrame) -> DataFrame:
    """The cells are a relation of their own, so that XML is parsed once for the several reads of them."""
    from .joins import _table_md

    return rendered(lambda d: f"with {_table_md(d, d.t('xmltable'))} select doc_id, page_number, region_seq, md from tables", {"xmltable": xmltable, "tok": tok})


@operator("reg", "structure", "xmlcell", "tok", spark=_xml_table_md, spark_inputs=("xmltable", "tok"))
def xml_table_md(d):
    """Markdown of tables whose last structure has no cells but XML with cells."""
    from .joins import _table_md

    return f"""with xc as ({_xml_table_cells(d)}),
 {_table_md(d, 'xc')} select doc_id, page_number, region_seq, md from tables"""


@operator("styled")
def title_level(d):
    """Heading level of titles and section headers by height over the common height."""
    return f"""with r as (select doc_id, page_number, pos, content, trim(content) as title, token_type, cast(height as double) / common_height as ratio from {d.t('styled')}),
 l as (select *, case when token_type not in (5, 8) then 0 when ratio > 1.99 then 1 when ratio > 1.39 then 2 when ratio > 1.19 then 3 else 4 end as level from r)
 select doc_id, page_number, pos, level, case when level = 0 then content else concat(repeat('#', level), ' ', title) end as md, case when level = 0 then content else concat('<h', level, '>', title, '</h', level, '>') end as html from l"""


@operator("linked")
def link_markdown(d):
    """Web links as Markdown and HTML: every occurrence of the link's text. References stay text."""
    return f"""select doc_id, page_number, pos, case when link_type = 'WEB_URL' then replace(content, link_text, concat('[', link_text, '](', link, ')')) else content end as md,
 case when link_type = 'WEB_URL' then replace(content, link_text, concat('<a href=', chr(34), link, chr(34), '>', link_text, '</a>')) else content end as html from {d.t('linked')}"""


@operator("leveled")
def list_markdown(d):
    """List items by level; the first character goes, even a blank."""
    return f"""select doc_id, page_number, pos, case when level < 0 then content else concat(repeat('  ', level), '- ', substr(content, 2)) end as md,
 case when level <= 0 then content else concat(repeat('<ul><li>', level), content, repeat('</li></ul>', level)) end as html from {d.t('leveled')}"""


@operator("tok", "font")
def style_markdown(d):
    """Bold or italic text; bold wins."""
    return f"""select t.doc_id, t.page_number, t.pos, case when f.bold then concat('**', t.content, '**') when f.italics then concat('_', t.content, '_') else t.content end as md,
 case when f.bold then concat('<b>', t.content, '</b>') when f.italics then concat('<i>', t.content, '</i>') else t.content end as html from {d.t('tok')} t left join {d.t('font')} f on t.doc_id = f.doc_id and t.font_id = f.font_id"""


@operator("tok", "page", "reg", "tsr", "cell")
def document_json(d):
    """Documents as JSON: pages with tokens and regions, the last structure of a table's box with its cells and their text under
    the table, and totals. Texts of cells are those of the tokens that overlap them, as in cell_text_json."""
    from .joins import cell_text_json, region_tsr_json

    text = (lambda x: f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)") if d.name == "spark" else (lambda x: f"cast(to_json({x}) as varchar)")
    box = lambda x0, y0, x1, y1: f"""'{{¤left¤:', {x0}, ',¤top¤:', {y0}, ',¤right¤:', {x1}, ',¤bottom¤:', {y1}, '}}'"""
    own = box('"left"', "top", '"right"', "bottom")
    part = lambda x: f"coalesce({x}, '')"
    display = "case token_type " + " ".join(f"when {i} then '{v}'" for i, (_, v) in enumerate(TOKEN_TYPES)) + " end"
    corner = {k: d.trunc(v) for k, v in (("x0", "c.x"), ("y0", "c.y"), ("x1", "c.x + c.w"), ("y1", "c.y + c.h"))}
    sql = f"""with ct as ({cell_text_json.template(d)}), rt as ({region_tsr_json.template(d)}),
 tj as (select {PAGE}, {d.listagg(f"""concat('{{¤text¤:', {text('content')}, ',¤token_type¤:¤', {display}, '¤,¤bounding_box¤:', {own}, '}}')""", "','", 'pos')} as js, count(*) as n from {d.t('tok')} group by {PAGE}),
 cj as (select c.doc_id, c.page_number, c.region_seq, {d.listagg(f"""concat('{{¤row¤:', c."row", ',¤col¤:', c.col, ',¤bounding_box¤:', {box(*corner.values())}, ',¤text¤:', {text('ct.txt')}, '}}')""", "','", 'c."row", c.col')} as js from {d.t('cell')} c
  join ct on c.doc_id = ct.doc_id and c.page_number = ct.page_number and c.region_seq = ct.region_seq and c."row" = ct."row" and c.col = ct.col group by c.doc_id, c.page_number, c.region_seq),
 rx as (select r.*, case when x.tsr_seq is not null then concat(',¤tsr_result¤:{{¤num_cells¤:', x.num_cells, ',¤cells¤:[', {part('cj.js')}, ']}}') else '' end as tsr from {d.t('reg')} r join rt x on r.doc_id = x.doc_id and r.page_number = x.page_number and r.region_seq = x.region_seq
  left join cj on r.doc_id = cj.doc_id and r.page_number = cj.page_number and r.region_seq = cj.region_seq),
 rj as (select {PAGE}, {d.listagg(f"""concat('{{¤region_type¤:¤', region_type, '¤,¤bounding_box¤:', {own}, ',¤width¤:', width, ',¤height¤:', height, ',¤area¤:', area, ',¤aspect_ratio¤:', round(aspect_ratio, 4), tsr, '}}')""", "','", 'region_seq')} as js, count(*) as n from rx group by {PAGE}),
 pj as (select p.doc_id, {d.listagg(f"""concat('{{¤page_number¤:', p.page_number, ',¤width¤:', p.page_width, ',¤height¤:', p.page_height, ',¤tokens¤:[', {part('tj.js')}, '],¤regions¤:[', {part('rj.js')}, ']}}')""", "','", 'p.page_number')} as js, count(*) as pages, sum(coalesce(tj.n, 0)) as tokens, sum(coalesce(rj.n, 0)) as regions
  from {d.t('page')} p left join tj on p.doc_id = tj.doc_id and p.page_number = tj.page_number left join rj on p.doc_id = rj.doc_id and p.page_number = rj.page_number group by p.doc_id)
 select doc_id, concat('{{¤pages¤:[', js, '],¤num_pages¤:', pages, ',¤num_tokens¤:', tokens, ',¤num_regions¤:', regions, '}}') as json from pj"""
    sql = sql.replace("¤", '"' if d.name == "duck" else "\\u0022")  # quotes of JSON; those of SQL stand for names
    return sql if d.name == "duck" else braced(sql, d, ("tok", "page", "reg", "tsr", "cell"))
