"""Relations that queries run on: page geometry derived from the text tables by integer arithmetic, the same in both engines."""

from __future__ import annotations

from .dual import Relations

FX = Relations()

#: Token types by index (name, display value).
TOKEN_TYPES = (("FORMULA", "Formula"), ("FOOTNOTE", "Footnote"), ("LIST_ITEM", "List item"), ("TABLE", "Table"), ("PICTURE", "Picture"), ("TITLE", "Title"), ("TEXT", "Text"), ("PAGE_HEADER", "Page header"), ("SECTION_HEADER", "Section header"), ("CAPTION", "Caption"), ("PAGE_FOOTER", "Page footer"))

DISPLAY = "(case token_type " + " ".join(f"when {i} then '{v}'" for i, (_, v) in enumerate(TOKEN_TYPES)) + " end)"


@FX.invent("tok", "documents")
def tok(d):
    """Tokens: a line of a document is a visual line, a sentence of it a fragment."""
    if d.name == "spark":  # nested, without names: a plan that is built twice then is equal, and what is kept is found
        lines = f"(select doc_id, posexplode(split(text, '\\n')) as (line_no, ln) from (select doc_id, text from {d.t('documents')} distribute by doc_id) t) l"
        parts = f"(select doc_id, line_no, frag_no, trim(x) as content from (select doc_id, line_no, posexplode(split(ln, '[.] ')) as (frag_no, x) from {lines}) f where length(trim(x)) > 0) f"
    else:
        lines = "(select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as ln from documents) l"
        parts = f"(select * from (select doc_id, line_no, unnest(range(len(string_split(ln, '. '))))::int as frag_no, trim(unnest(string_split(ln, '. '))) as content from {lines}) f0 where length(content) > 0) f"
    return f"""select doc_id, page_number, cast(row_number() over (partition by doc_id, page_number order by line_no, frag_no) as int) as pos, line_no, frag_no, content,
 "left", top, "left"+width as "right", top+height as bottom, width, height,
 cast((doc_id + line_no) % 4 as int) as font_id, cast((doc_id*7 + line_no*3 + frag_no*5) % 11 as int) as token_type from (select *, cast({d.idiv('line_no', '20')} + 1 as int) as page_number,
 cast(50 + coalesce(sum(length(content)*4+8) over (partition by doc_id, line_no order by frag_no rows between unbounded preceding and 1 preceding), 0) as int) as "left",
 cast(60 + (line_no % 20)*16 + (case when line_no % 5 = 0 then 0 else 3 end) + frag_no % 2 as int) as top,
 cast(length(content)*4 as int) as width, cast(10 + (doc_id + line_no) % 5 as int) as height from {parts}) g"""


@FX.invent("page", "tok")
def page(d):
    return f"select doc_id, page_number, 612 as page_width, 792 as page_height from (select distinct doc_id, page_number from {d.t('tok')})"


@FX.invent("font", "tok")
def font(d):
    """Four fonts a document."""
    return f"select n.doc_id, cast(c1 as int) as font_id, c2 as family, cast(c3 as double) as font_size, contains(c2, 'Bold') as bold, contains(c2, 'Italic') as italics, '#000000' as color from (values (0, 'Times', 12), (1, 'Times-Bold', 14), (2, 'Helvetica-Italic', 10), (3, 'Helvetica-BoldItalic', 12)) v(c1, c2, c3) cross join (select distinct doc_id from {d.t('tok')}) n"


@FX.invent("reg", "page")
def reg(d):
    return f"""select doc_id, page_number, k as region_seq,
 cast(40 + (doc_id*13 + page_number*7 + k*29) % 300 as int) as "left", cast(50 + (doc_id*11 + page_number*5 + k*37) % 280 as int) as top,
 cast(40 + (doc_id*13 + page_number*7 + k*29) % 300 + 40 + (doc_id*3 + k*53) % 200 as int) as "right",
 cast(50 + (doc_id*11 + page_number*5 + k*37) % 280 + 30 + (doc_id*5 + k*41) % 120 as int) as bottom,
 cast(40 + (doc_id*3 + k*53) % 200 as int) as width, cast(30 + (doc_id*5 + k*41) % 120 as int) as height,
 cast((40 + (doc_id*3 + k*53) % 200) * (30 + (doc_id*5 + k*41) % 120) as int) as area,
 case cast((doc_id + k) % 7 as int) when 0 then 'Table' when 1 then 'Photo' when 2 then 'Figure' when 3 then 'Chart' when 4 then 'Logo' when 5 then 'Formula' else 'ScannedPage' end as region_type,
 cast((doc_id*17 + k*23) % 100 as double) / 100 as fill_density, cast((doc_id*19 + k*7) % 20 as double) / 100 as edge_density, cast((doc_id*29 + k*31) % 1000 as double) as color_variance,
 cast((40 + (doc_id*3 + k*53) % 200) as double) / (30 + (doc_id*5 + k*41) % 120) as aspect_ratio,
 cast((doc_id + k) % 6 as int) as h_lines, cast((doc_id + 2*k) % 6 as int) as v_lines
from {d.t('page')} p cross join (values (0),(1),(2),(3),(4),(5)) t(k)"""


@FX.invent("emi", "tok")
def emi(d):
    """Emission probabilities of the 11 types."""
    if d.name == "spark":
        w = [f"cast(1 + (doc_id*31 + pos*17 + {k}*7 + (pos*{k}) % 5) % 29 as double)" for k in range(11)]
        return f"select doc_id, page_number, pos, array({', '.join(f'w{k} / s' for k in range(11))}) as p from (select *, {' + '.join(f'w{k}' for k in range(11))} as s from (select doc_id, page_number, pos, {', '.join(f'{x} as w{k}' for k, x in enumerate(w))} from {d.t('tok')}))"
    return "select doc_id, page_number, pos, list_transform(w, lambda x: x / list_sum(w)) as p from (select doc_id, page_number, pos, list_transform(range(11), lambda k: (1 + (doc_id*31 + pos*17 + k*7 + (pos*k) % 5) % 29)::double) as w from tok)"


@FX.invent("lab", "tok")
def lab(d):
    """Layout labels: boxes of every other token, moved and stretched a little."""
    return f"""select doc_id, page_number, pos as seq, "left" - 3 + pos % 5 as "left", top - 2 + pos % 4 as top, width + 2 + pos % 9 as width, height + pos % 6 as height,
 cast((token_type + pos) % 11 as int) as label_type from {d.t('tok')} where pos % 2 = 1"""


@FX.invent("cell", "reg")
def cell(d):
    """A grid of three by three cells in each table region, relative to it; some grids have gaps and missing rows."""
    return f"""select doc_id, page_number, region_seq, "left" as region_left, top as region_top, r as "row", c as col, cast(c * {d.idiv('width', '3')} as double) as x, cast(r * {d.idiv('height', '3')} as double) as y,
 cast({d.idiv('width', '3')} as double) as w, cast({d.idiv('height', '3')} as double) as h
 from {d.t('reg')} cross join (values (0),(1),(2)) a(r) cross join (values (0),(1),(2)) b(c) where region_type = 'Table'
 and not (doc_id % 5 = 2 and r = 1) and not (doc_id % 4 = 3 and (r + c) % 3 = 1)"""


@FX.invent("tsr", "reg")
def tsr(d):
    """Table structures, two of the same box for every other region."""
    return f"""select doc_id, page_number, "left", top, "right", bottom, region_seq * 2 + k as tsr_seq, 9 + k as num_cells from {d.t('reg')} cross join (values (0),(1)) t(k)
 where region_type = 'Table' and (k = 0 or doc_id % 2 = 0)"""


@FX.invent("box", "reg")
def box(d):
    """Boxes as table recognition finds them, in the pixels of a crop of 200 by 160."""
    return f"""select doc_id, page_number, region_seq, k as seq, cast((doc_id*7 + k*37 + region_seq*11) % 200 as int) as x, cast((doc_id*5 + k*k*13) % 160 as int) as y,
 cast(20 + (k*97 + doc_id) % 170 as int) as w, cast(8 + (k*5) % 20 as int) as h, 200 as img_w, 160 as img_h
 from {d.t('reg')} cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) t(k) where region_type = 'Table'"""


@FX.invent("img", "page")
def img(d):
    """Embedded image objects: the matrix of the unit square."""
    return f"""select doc_id, page_number, k as seq, cast(page_width as double) as page_w, cast(page_height as double) as page_h, cast(40 + (doc_id*31 + k*211) % 560 as double) as a, cast((doc_id + k) % 3 as double) as b,
 cast((doc_id*3 + k) % 4 as double) as c, cast(60 + (doc_id*17 + k*311) % 720 as double) as d, cast((doc_id*7 + k*5) % 60 as double) as e, cast((doc_id*5 + k*3) % 50 as double) as f, (doc_id + k) % 2 = 0 as has_text
 from {d.t('page')} cross join (values (0),(1),(2)) t(k)"""


@FX.invent("pred", "tok")
def pred(d):
    """Predictions by place: some moved a little, some far, some missing, some twice."""
    return f"""select doc_id, page_number, pos * 2 + k as seq, "left" + (case when pos % 7 = 3 then 5 when pos % 11 = 5 then 40 else 0 end) as "left", top, cast((token_type + k) % 11 as int) as token_type
 from {d.t('tok')} cross join (values (0),(1)) t(k) where pos % 13 <> 8 and (k = 0 or pos % 5 = 0)"""


@FX.invent("ord", "tok")
def ord_(d):
    """Tokens with a reading order: mostly that of the document, some swapped."""
    return f"""select *, cast(case when pos % 6 = 4 then pos + 2 else pos end as int) as reading_order_no from {d.t('tok')}"""


@FX.invent("raw", "reg")
def raw(d):
    """Rectangles with sides of no length and reversed sides."""
    return f"""select doc_id, page_number, region_seq, "left", top, case region_seq % 3 when 0 then "left" when 1 then "left" - 7 else "right" end as "right", case region_seq % 4 when 0 then bottom when 1 then top else top - 5 end as bottom from {d.t('reg')}"""


@FX.invent("cand", "reg")
def cand(d):
    """Candidates: regions ten times as large, some beyond the page's edges, some outside the page."""
    return f"""select doc_id, page_number, region_seq, "left" - 60 + (case when (doc_id + region_seq) % 9 = 4 then 700 else 0 end) as "left", top - 60 as top, "right" + 100 as "right", bottom + 400 as bottom, area * 10 as area from {d.t('reg')}"""


@FX.invent("printed", "tok")
def printed(d):
    """Tokens, but those of every third page, which is a scan."""
    return f"select * from {d.t('tok')} where (doc_id + page_number) % 3 <> 0"


@FX.invent("pictured", "img")
def pictured(d):
    """Embedded images of some pages."""
    return f"select * from {d.t('img')} where (doc_id + page_number) % 4 = 0"


@FX.invent("names", "tok")
def names(d):
    """Indexes and names of token types, right and wrong ones."""
    return f"""select doc_id, page_number, pos, token_type + pos % 5 - 2 as k, case when pos % 4 = 0 then 'list_item' when pos % 4 = 1 then 'List item' when pos % 4 = 2 then 'Caption' else substr(content, 1, 7) end as n from {d.t('tok')}"""


@FX.invent("guess", "tok", "pred")
def guess(d):
    """Types and predicted types of tokens."""
    return f"""select t.doc_id, t.page_number, t.pos, p.seq, t.token_type, p.token_type as predicted_type from {d.t('tok')} t join {d.t('pred')} p on t.doc_id = p.doc_id and t.page_number = p.page_number and {d.idiv('p.seq', '2')} = t.pos"""


@FX.invent("judged", "guess")
def judged(d):
    """Truths and predictions as numbers, with halves among them."""
    return f"""select doc_id, page_number, pos, seq, case when pos % 3 = 0 then 1 else token_type end as truth, case when pos % 2 = 0 then cast(0 as double) else cast(predicted_type as double) + 0.5 end as prediction from {d.t('guess')}"""


@FX.invent("frag", "tok")
def frag(d):
    """Tokens as fragments of lines."""
    return f"""select doc_id, page_number, line_no, frag_no, content, "left", top, "right", bottom, token_type from {d.t('tok')}"""


@FX.invent("cropped", "reg")
def cropped(d):
    """Regions with the bytes of their crops, which are missing for every other one."""
    crop = "encode(region_type, 'UTF-8')" if d.name == "spark" else "encode(region_type)"
    return f"select *, case when region_seq % 2 = 0 then {crop} end as crop from {d.t('reg')}"


@FX.invent("structure", "tsr")
def structure(d):
    """Table structures: cells of some, XML of others, which can be read or not."""
    box = lambda c: f"""'<cell row=~{c}~ column=~', doc_id % 3, '~><boundingbox x=~{20 * c}~ y=~', page_number % 7, '~ w=~60.5~ h=~30~/></cell>'"""
    cells = f"""replace(concat('<table>', {box(0)}, {box(2)}, '<cell row=~1~ column=~9~></cell></table>'), '~', chr(34))"""
    xml = f"case when tsr_seq % 12 = 0 then null when tsr_seq % 12 in (2, 4) then '<broken' when (doc_id + tsr_seq) % 3 = 0 then '<table/>' else {cells} end"
    return f"""select doc_id, page_number, "left", top, tsr_seq, case when tsr_seq % 12 in (6, 8) then num_cells else 0 end as num_cells, {xml} as xml, tsr_seq % 12 not in (0, 2, 4) as readable from {d.t('tsr')}"""


@FX.invent("styled", "tok")
def styled(d):
    """Tokens with the common height of a document's text, and digits here and there."""
    return f"""select doc_id, page_number, pos, case when pos % 3 = 0 then cast(pos as {'string' if d.name == 'spark' else 'varchar'}) else content end as content, token_type, "left", top, "right", bottom, width, height, cast(5 + doc_id % 15 as int) as common_height from {d.t('tok')}"""


@FX.invent("linked", "tok")
def linked(d):
    """Tokens with links: web links, references and none."""
    return f"""select doc_id, page_number, pos, content, case when pos % 3 = 2 then '' else substr(content, 1, 3) end as link_text, case when pos % 3 = 0 then concat('http://z.example/', pos) when pos % 3 = 1 then '#p1' else '' end as link,
 case when pos % 3 = 0 then 'WEB_URL' when pos % 3 = 1 then 'DOCUMENT_REFERENCE' else 'NO_LINK' end as link_type from {d.t('tok')}"""


@FX.invent("listed", "tok")
def listed(d):
    """Tokens of which some begin with a list marker, some after blanks."""
    marker = " ".join(f"when {i} then '{m}'" for i, m in enumerate(("-", "•", "‣", "⁃", "◦", "⦿", "*")))
    return f"""select doc_id, page_number, pos, case when pos % 2 = 0 then concat(case when pos % 8 = 0 then '  ' else '' end, case (pos + doc_id) % 7 {marker} end, ' ', content) else content end as content from {d.t('tok')}"""
