"""What is dealt by document stays where it is: folds, joins and groups of a page's rows need no further exchange."""

import random

import numpy as np
import pytest

from pagewright.operators import sequence
from pagewright.plans import queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dealt"))
    words = random.Random(5)
    texts = ["\n".join(". ".join(f"w{words.randrange(90)} x" for _ in range(words.randrange(1, 4))) for _ in range(30)) for _ in range(12)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("key", ["page_markdown", "line_blocks", "md_table", "viterbi_labels"])
def test_text_is_dealt_once(spark, sf, key):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")  # as if relations were large
    try:
        df = queries.queries()[key](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own = plan.split("InMemoryRelation")[0]
    assert "page_number" not in "".join(line for line in own.splitlines() if " Exchange hashpartitioning" in line)


def test_blocks_are_those_of_a_walk(spark):
    r = random.Random(3)
    rows = [(d, p, o, r.random() < 0.2, o, r.choice([0, 3, 4, 5, 6, 8]), r.randrange(200), r.randrange(200), f"t{o}") for d in range(6) for p in (1, 2) for o in range(1, r.randrange(3, 40))]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, ord int, is_region boolean, region_seq int, etype int, top int, bottom int, txt string").repartition(5)
    found = {(x.doc_id, x.page_number, x.ord): (x.block_no, x.block_type, x.txt) for x in sequence._blocks_spark(df).collect()}
    column = lambda i: np.array([x[i] for x in rows])
    first = np.array([x[2] == 1 for x in rows])
    blocks, types = sequence.fold_blocks(column(3), column(5), column(6), column(7), first)
    assert found == {x[:3]: (b, t, x[8]) for x, b, t in zip(rows, blocks, types, strict=True)}
