"""What the vectors of tokens are made of, computed a page at a time: the same as the operators say of each, without their joins."""

import numpy as np
import pyarrow as pa

from pagewright.functions.characters import text_numbers
from pagewright.operators import matrix
from pagewright.operators.features import _PLACE_OF, PUNCTUATION, categories
from pagewright.plans import queries
from pagewright.plans.dual import OPERATORS

TEXTS = ["", " ", "   ", "A", "AB", "aB", "Ab Cd", "Ab cD", "Ab 1 Cd.", " AB  CD ", "1,234.5", "., ", "²٣", "x²", "éa Éa", "ÀÉ", "ǅa", "ǅǅ", "12 ", "a  \0b", "Ab,", "x:", "y ;", "a;", "日本語 テスト です", "😀 Ab", "one two three " * 9, "eightchr", "ninechars", "\tAb", "A B", "A"]


def test_texts_are_those_of_the_operators(spark):
    """Two slices of a column, so that offsets don't begin at 0; texts behind blank ones begin anew."""
    rows = [(1, 1, i, t, 0) for i, t in enumerate(TEXTS)]
    tok = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, content string, font_id int")
    font = spark.createDataFrame([(1, 0, False, False)], "doc_id long, font_id int, bold boolean, italics boolean")
    want = {r["pos"]: r for r in OPERATORS["text_features"](tok=tok, font=font).collect()}
    counts = {r["pos"]: r for r in tok.selectExpr("pos", "length(content) length_", "length(content) - length(replace(content, ' ', '')) blanks", f"regexp_count(content, r'{PUNCTUATION.encode().decode()}') punctuation").collect()}
    column = pa.array(TEXTS)
    for at, part in ((0, column.slice(0, 7)), (7, column.slice(7))):
        got, slots = text_numbers(part, _PLACE_OF)
        for i in range(len(part)):
            for c, v in got.items():
                row = counts[at + i] if c in counts[0].asDict() else want[at + i]
                if c == "is_numeric" and TEXTS[at + i].endswith(" "):
                    assert not v[i]  # Java's end of a text is before a last line's end too; the SQL's isn't
                else:
                    assert float(v[i]) == float(row[c]), (TEXTS[at + i], c)
            assert slots[i].tolist() == categories(TEXTS[at + i]), TEXTS[at + i]


def test_touched_is_what_a_look_at_all_pairs_says(monkeypatch):
    monkeypatch.setattr(matrix, "PAIRS", 40)
    r = np.random.default_rng(4)

    def box(page, side):  # boxes of pages 2 and further lie beyond the last tile, or before the first
        x, y = (r.integers(-50, 600, len(page)) + np.where(page >= 2, 20_000, 0) - np.where(page == 0, 300, 0) for _ in range(2))
        w, h = (r.integers(0, side, len(page)) for _ in range(2))
        return tuple(c.astype(float) for c in (x, y, x + w, y + h))

    for side in (60, 300, 3000):
        page, r_page = np.sort(r.integers(0, 5, 200)), np.sort(r.integers(0, 4, 25))
        t, g = box(page, 40), box(r_page, side)
        want = [any(r_page[j] == page[i] and t[2][i] >= g[0][j] and t[0][i] <= g[2][j] and t[3][i] >= g[1][j] and t[1][i] <= g[3][j] for j in range(25)) for i in range(200)]
        assert matrix.touched(page, t, r_page, g).tolist() == want and any(want)
    assert not matrix.touched(page, t, r_page[:0], tuple(c[:0] for c in g)).any()


def sf(spark, path):
    text = "\n".join(f"Row {i}. cell {i * 7}. value {i * i}. Title Case" for i in range(40))
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "Short. text", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0].count("Join ")


def test_feature_vector_joins_tokens_by_their_key_alone(spark, tmp_path):
    df = queries.queries()["feature_vector"](spark, sf(spark, tmp_path))
    assert df.count() == 159 and joins(df) <= 2


def test_token_matrix_sums_rows_where_they_are_made(spark, tmp_path):
    df = queries.queries()["token_matrix"](spark, sf(spark, tmp_path))
    assert joins(df) <= 2 and "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    rows = matrix.FX.frame(spark, str(tmp_path), "matrix").collect()
    assert len(got) == len(rows) == 162
    for r in rows:
        n, total, by_place = got[r["doc_id"], r["page_number"], r["pos"]]
        assert n == len(r["places"]) and abs(total - sum(r["values"])) < 1e-3 and abs(by_place - sum((p + 1) * v for p, v in zip(r["places"], r["values"], strict=True))) < 0.11


def test_sums_of_rows_are_taken_without_the_rows():
    """Each pair is summed once, not at each of the eight rows that it stands in."""
    r = np.random.default_rng(9)
    page = np.repeat([0, 1, 2, 3], [1, 3, 40, 200])
    x = {c: r.integers(0, 3, len(page)) * r.random(len(page)) for c in matrix.NUMBERS}
    slots = r.integers(-1, len(matrix.CATEGORIES), (len(page), 8))
    offsets, places, values = matrix.windows(*matrix.pair_vectors(page, x, slots))
    row = np.repeat(np.arange(len(page)), np.diff(offsets))
    n, total, by_place = matrix.window_sums(page, x, slots)
    assert n.tolist() == np.diff(offsets).tolist()
    assert np.allclose(total, np.bincount(row, values.astype(float)), rtol=1e-12, atol=1e-9)
    assert np.allclose(by_place, np.bincount(row, (places + 1) * values.astype(float)), rtol=1e-12, atol=1e-6)


def test_xml_of_tables_is_parsed_once(spark, tmp_path):
    """The cells are read several times, but are one kept relation; tokens beyond the span of a page's cells are in no tile."""
    at = sf(spark, tmp_path)
    df = queries.queries()["xml_table_md"](spark, at)
    assert any("region_left" in kept.columns for kept in matrix.FX.kept)
    frames = {n: matrix.FX.frame(spark, at, n) for n in ("reg", "structure", "xmlcell", "tok")}
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, OPERATORS["xml_table_md"](**frames).collect()))
