"""Operators written once as SQL and rendered for Spark or for the DuckDB oracle.

A template is a function of a dialect; identifiers stand in double quotes, relations come from dialect.t(name). An operator
may carry a Spark implementation of its own where SQL isn't the best plan; its template then only serves as the oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_document


class Spark:
    name = "spark"

    def t(self, relation: str) -> str:
        return "{" + relation + "}"

    def listagg(self, value: str, sep: str, order: str) -> str:
        return f"listagg({value}, {sep}) within group (order by {order})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def half_even(self, x: str) -> str:
        return f"cast(bround({x}, 0) as bigint)"

    def lstrip(self, x: str) -> str:
        return f"regexp_replace({x}, '^\\\\s+', '')"

    def trunc(self, x: str) -> str:
        return f"cast({x} as int)"

    def words(self, x: str) -> str:
        return f"filter(split({x}, ' '), w -> w <> '')"

    def count_of(self, x: str, what: str) -> str:
        return f"cast(length({x}) - length(replace({x}, {what}, '')) as int)"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} rlike '{pattern}'".replace("\\", "\\\\")

    def matches_count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, '{pattern}') as int)".replace("\\", "\\\\")

    def upto(self, x: str) -> str:
        return f"explode(sequence(0, {x}))"

    newline, real = "'\\n'", "double"


class Duck(Spark):
    name = "duck"

    def t(self, relation: str) -> str:
        return relation

    def listagg(self, value: str, sep: str, order: str) -> str:
        return f"string_agg({value}, {sep} order by {order})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def half_even(self, x: str) -> str:
        return f"cast(round_even({x}, 0) as bigint)"

    def lstrip(self, x: str) -> str:
        return f"regexp_replace({x}, '^\\s+', '')"

    def trunc(self, x: str) -> str:
        return f"cast(trunc({x}) as int)"

    def words(self, x: str) -> str:
        return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def matches_count(self, x: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({x}, '{pattern}')) as int)"

    def upto(self, x: str) -> str:
        return f"unnest(range({x} + 1))"

    newline = "chr(10)"


def braced(sql: str, d: Spark, relations: tuple[str, ...]) -> str:
    """For Spark's SQL formatter: braces doubled but those around names of relations."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for r in relations:
        sql = sql.replace("{" + d.t(r) + "}", d.t(r))
    return sql


#: Views that rendered SQL reads. They outlive their query's analysis, since dropping a view also drops what is kept of its plan.
_views: list[str] = []


def rendered(template: Callable, frames: dict[str, DataFrame]) -> DataFrame:
    """The template's Spark SQL over frames by the names of relations."""
    spark, names = next(iter(frames.values())).sparkSession, {}
    for k, v in frames.items():
        names[k] = f"pagewright_{uuid.uuid4().hex}_{k}"
        v.createOrReplaceTempView(names[k])
    _views.extend(names.values())
    out = spark.sql(template(Spark()).format(**names).replace('"', "`"))
    forget(spark, 1024)
    return out


def forget(spark: SparkSession, most: int = 0) -> None:
    """Drops the oldest views but for `most`."""
    while len(_views) > most:
        spark.catalog.dropTempView(_views.pop(0))


@dataclass(frozen=True)
class Operator:
    """Callable with its input relations as keyword DataFrames."""

    key: str
    inputs: tuple[str, ...]
    template: Callable | None
    spark_form: Callable | None = None
    doc: str = ""
    spark_inputs: tuple[str, ...] = ()

    @property
    def reads(self) -> tuple[str, ...]:
        """The relations that are read in Spark: those of the oracle, if the Spark form has none of its own."""
        return self.spark_inputs or self.inputs

    def __call__(self, **frames: DataFrame) -> DataFrame:
        if self.spark_form and (not self.spark_inputs or all(k in frames for k in self.spark_inputs)):
            return self.spark_form(**{k: frames[k] for k in self.reads})
        return rendered(self.template, {k: frames[k] for k in self.inputs})

    def oracle(self) -> str | None:
        return self.template(Duck()) if self.template else None


#: All operators by key.
OPERATORS: dict[str, Operator] = {}


def operator(*inputs: str, spark: Callable | None = None, key: str | None = None, spark_inputs: tuple[str, ...] = ()):
    def made(template: Callable) -> Operator:
        name = key or template.__name__
        OPERATORS[name] = Operator(name, inputs, template, spark, template.__doc__ or "", spark_inputs)
        return OPERATORS[name]

    return made


def frame_operator(*inputs: str, key: str | None = None):
    """An operator that only has a Spark form."""

    def made(form: Callable) -> Operator:
        name = key or form.__name__
        OPERATORS[name] = Operator(name, inputs, None, form, form.__doc__ or "")
        return OPERATORS[name]

    return made


#: Column of kept tokens that orders them.
PLACE = "_place"

#: Relations that are worth keeping, inner ones first, and reads from which they are kept.
SHARED, LEAST = ("tok", "lines", "sweep", "xmltable"), 2

#: Of these the ones whose readers each read them several times.
OFTEN = ("xmltable",)


class Relations:
    """Relations by name, each derived from tables or other relations; built when asked for."""

    def __init__(self):
        self.made: dict[str, tuple[tuple[str, ...], Callable, Callable | None]] = {}
        self.invented: set[str] = set()
        self.kept: list[DataFrame] = []

    def add(self, name: str, *inputs: str, spark: Callable | None = None):
        """A relation that follows from others."""

        def made(template: Callable) -> Callable:
            self.made[name] = (inputs, template, spark)
            return template

        return made

    def invent(self, name: str, *inputs: str, spark: Callable | None = None):
        """A relation of test data: of use over the tables only, never beside a user's own relations."""
        self.invented.add(name)
        return self.add(name, *inputs, spark=spark)

    def frame(self, spark: SparkSession, sf_dir: str, name: str, given: dict | None = None, shared: dict | None = None) -> DataFrame:
        """A relation over given ones or, without them, over the tables below sf_dir. Each use of a relation is a plan of its
        own: Spark's analyser can fail to tell two uses of one apart when Python stages lie between; equal exchanges are
        still found and run once. Beside given relations nothing is invented: what neither is given nor follows from given
        ones is an error."""
        if given is not None and name in given:
            return given[name]
        if shared and name in shared:  # columns by aliases: each use has its own
            return shared[name].select(*[F.col(c).alias(c) for c in shared[name].columns if c != PLACE])
        if given is not None and (name in self.invented or name not in self.made):
            raise KeyError(f"the relation {name!r} must be given")
        if name not in self.made:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        inputs, template, form = self.made[name]
        frames = {i: self.frame(spark, sf_dir, i, given, shared) for i in inputs}
        return form(**frames) if form else rendered(template, frames)

    def uses(self, templates: list, out: dict[str, int] | None = None) -> dict[str, int]:
        """How often each relation is read in all, where templates (inputs, template, form) are run once each."""
        out = {} if out is None else out
        for inputs, template, form in templates:
            text = "" if form else template(Spark())
            for i in inputs:
                n = 1 if form else text.count("{" + i + "}")
                out[i] = out.get(i, 0) + n
                if i in self.made:
                    self.uses([self.made[i]] * n, out)
        return out

    def frames(self, spark: SparkSession, sf_dir: str, op: Operator) -> dict[str, DataFrame]:
        """An operator's inputs over the tables. A relation of SHARED that the operator reads at least LEAST times in all is
        computed once, kept in memory and on the executors' disks (lost blocks are computed again) until the next operator's
        inputs are asked for. Tokens are kept in order of their places, by which operators join and group them."""
        by_document(spark)
        for df in self.kept:
            df.unpersist()
        forget(spark)
        reads = self.uses([(op.reads, op.template, op.spark_form)])
        shared: dict[str, DataFrame] = {}
        for n in SHARED:
            if n in self.made and reads.get(n, 0) >= (1 if n in OFTEN else LEAST):
                made = self.frame(spark, sf_dir, n, None, shared)
                if n == "tok":  # by a window, whose order the kept plan tells to the joins above
                    made = made.withColumn(PLACE, F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("pos")))
                shared[n] = made.persist()
        self.kept = list(shared.values())
        return {i: self.frame(spark, sf_dir, i, None, shared) for i in op.reads}

    def needed(self, names: tuple[str, ...], out: list[str] | None = None) -> list[str]:
        out = [] if out is None else out
        for n in names:
            if n in self.made and n not in out:
                self.needed(self.made[n][0], out)
                out.append(n)
        return out

    def oracle(self, op: Operator) -> str | None:
        body = op.oracle()
        if body is None:
            return None
        parts = [f"{n} as ({self.made[n][1](Duck())})" for n in self.needed(op.inputs)]
        return f"with recursive {', '.join(parts)} select * from ({body})" if parts else f"with recursive one as (select 1) select * from ({body})"
