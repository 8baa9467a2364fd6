"""How the vocabulary of a source differs from those of the other sources of its language.

Documents are counted by DuckDB inside Spark tasks, then dealt into shards by a hash of language
and term, so that all that is known of a term lies in one shard. Each shard runs vectorised SQL: it
counts occurrences and documents, keeps the terms of enough documents, and, once the totals of all
shards are known, sums the divergences of pairs of sources over its terms and ranks its own terms.
Spark merges the shards' sums and rankings. All arithmetic is on integers.

A pair's sum runs over all kept terms, also those that neither source has. Shards make no rows for
these: a term that a source lacks has the source's least p, so a pair's sum is that of two empty
sources (`base`), plus what each source's own terms change, plus what shared terms change beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent_if_small, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: p is in parts of this.
SCALE = 1_000_000_000
#: Rows that a task holds before it hands them on (documents) or adds up those alike (shards).
HELD_ROWS = 400_000
#: Bytes of text for which there is one shard.
SHARD_BYTES = 4_000_000


def engine():
    """A DuckDB of one thread, as Spark runs a task for each core, that holds all in memory."""
    import duckdb

    c = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
    do(c, "SET preserve_insertion_order = false")
    return c


def do(c, statement: str) -> list[tuple]:
    return c.execute(statement).fetchall()


def count_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), added up within the task."""
    c = engine()
    do(c, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    drain = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL ORDER BY lang, source"
    for part in parts:
        for begin in range(0, part.num_rows, 500):
            some = part.slice(begin, 500)
            some = some.set_column(2, "text", pc.ascii_lower(some.column(2)))  # A-Z only
            c.register("batch", pa.Table.from_batches([some]))
            do(
                c,
                f"""INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM (
                  SELECT lang, source, row, term, count(*) AS n FROM (
                    SELECT lang, source, row, unnest(regexp_extract_all(text, '{TERM}')) AS term
                    FROM (SELECT *, row_number() OVER () AS row FROM batch)
                  ) GROUP BY ALL
                ) GROUP BY ALL""",
            )
            c.unregister("batch")
            if do(c, "SELECT count(*) FROM held")[0][0] > HELD_ROWS:
                yield from c.sql(drain).to_arrow_table().to_batches(20_000)
                do(c, "TRUNCATE held")
    yield from c.sql(drain).to_arrow_table().to_batches(20_000)
    c.close()


def shards(
    rows: DataFrame, n: int, table: str, results: list[str], schema: str, before: str | None = None, alike: str | None = None
) -> DataFrame:
    """Rows dealt by a hash of lang and term into n shards; what the queries `results` give for each.

    A shard's rows are the table `rows`; the statement `before` runs first. `alike`, where given, is a
    query that adds up rows alike; it runs whenever HELD_ROWS new ones have come, so that a term with
    a row from each of very many tasks doesn't fill a shard's memory.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = engine()
        do(c, f"CREATE TABLE rows ({table})")
        new = 0
        for part in parts:
            c.register("batch", pa.Table.from_batches([part]))
            do(c, "INSERT INTO rows SELECT * FROM batch")
            c.unregister("batch")
            new += part.num_rows
            if alike and new > HELD_ROWS:
                do(c, f"CREATE TABLE fewer AS {alike}")
                do(c, "DROP TABLE rows")
                do(c, "ALTER TABLE fewer RENAME TO rows")
                new = 0
        if before:
            do(c, before)
        for query in results:
            yield from c.sql(query).to_arrow_table().select(names).to_batches(20_000)
        c.close()

    return rows.repartition(n, "lang", "term").mapInArrow(run, schema)


def counted(docs: DataFrame, n: int, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences of the terms in at least so many of a language's documents.

    `lang_n` are those in the language; `first` is 1 in one row of each term, else 0.
    """
    schema = "lang string, source string, term string, n long, docs long"
    partial = docs.select("lang", "source", "text").mapInArrow(count_terms, schema)
    alike = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL"
    kept = f"""
      SELECT lang, source, term, n, (sum(n) OVER same)::BIGINT AS lang_n,
        (source = min(source) OVER same)::BIGINT AS first
      FROM ({alike}) WINDOW same AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER same >= {least}"""
    table = "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT"
    schema = "lang string, source string, term string, n long, lang_n long, first long"
    return shards(partial, n, table, [kept], schema, alike=alike)


def _p(n: str, total: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total}))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


def scored(cells: DataFrame, n: int, ranks: int) -> DataFrame:
    """Each shard's share, of cells with `total` and `lang_total` (N + V): kind, lang, source, item, p, value, count.

    kind `shared`: what the terms of both source and item change beyond what each changes alone.
    kind `own`: how many of a source's terms have this p. kind `term`: a source's first `ranks` terms.
    """
    with_p = f"""CREATE TABLE x AS SELECT lang, source, term, {_p("n", "total")} AS p, {_p("0", "total")} AS p0,
      {_p("lang_n", "lang_total")} AS q FROM rows"""
    change = f"{_f('a.p', 'b.p')}::HUGEINT - {_f('a.p', 'b.p0')} - {_f('a.p0', 'b.p')} + {_f('a.p0', 'b.p0')}"
    shared = f"""SELECT 'shared' AS kind, a.lang, a.source, b.source AS item, NULL::BIGINT AS p,
      sum({change})::DECIMAL(38, 0) AS value, NULL::BIGINT AS count
      FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
    own = """SELECT 'own' AS kind, lang, source, NULL::VARCHAR AS item, p, NULL::DECIMAL(38, 0) AS value,
      count(*) AS count FROM x GROUP BY ALL"""
    term = f"""SELECT 'term' AS kind, lang, source, term AS item, p, {_f("p", "q")}::DECIMAL(38, 0) AS value,
      NULL::BIGINT AS count FROM x WHERE p > q
      QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f("p", "q")} DESC, term) <= {ranks}"""
    table = "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, lang_n BIGINT, total BIGINT, lang_total BIGINT"
    rows = cells.select("lang", "source", "term", "n", "lang_n", "total", "lang_total")
    schema = "kind string, lang string, source string, item string, p long, value decimal(38,0), count long"
    return shards(rows, n, table, [shared, own, term], schema, before=with_p)


def _pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language."""
    f = lambda p, q: f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(38, 0))"
    p0 = F.expr(f"case when total > 0 then 1 + {SCALE} div total else 1 end").alias("p0")
    a = groups.select("lang", "source", "terms", p0)
    b = groups.select("lang", F.col("source").alias("item"), p0.alias("q0"))
    base = a.join(b, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"terms * {f('p0', 'q0')}").alias("v"))
    own = found.where("kind = 'own'").groupBy("lang", "source", "p").agg(F.sum("count").alias("m"))
    own = own.join(a.select("lang", "source", "p0"), ["lang", "source"]).join(b, "lang").where("source <> item")
    as_source = f"struct(source as source, item as item, m * ({f('p', 'q0')} - {f('p0', 'q0')}) as v)"
    as_item = f"struct(item as source, source as item, m * ({f('q0', 'p')} - {f('q0', 'p0')}) as v)"
    own = own.select("lang", F.expr(f"inline(array({as_source}, {as_item}))"))
    shared = found.where("kind = 'shared'").select("lang", "source", "item", F.col("value").alias("v"))
    exact = lambda d: d.withColumn("v", F.col("v").cast("decimal(38,0)"))
    every = exact(base).unionByName(exact(own)).unionByName(shared)
    return every.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def source_divergence(docs: DataFrame, least: int = 3, ranks: int = 200, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of (text, lang, source); null reads as ''.

    A language keeps the terms of at least `least` of its rows; of rows that repeat, each counts. p of a
    term in a group is 1 + floor(SCALE (n + 1) / (N + V)), N the group's occurrences of the V kept terms.
    Part `pair`: each other source of the language by the sum of floor((p - q)^2 / q) over all kept terms,
    q the other's p; 0 where none is kept. Part `term`: the group's own terms with p above the language's
    q, by the same figure, the first `ranks`. Ties go by item, in the order of UTF-8. A text without a
    term counts for its group only; an empty table gives an empty one. Other columns are ignored.

    A task holds HELD_ROWS counts or a shard, which is 1 / n of the terms, however often they occur.
    """
    empty = F.lit("")
    d = docs.select(*[F.coalesce(c, empty).alias(c) for c in ("text", "lang", "source")])
    sizes = cut(d.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")))
    n = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    cells, _ = stored(counted(d, n, least))
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("terms"))
    groups = sizes.select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.na.fill(0, ["n", "lang_n", "terms"]).withColumn("total", F.expr("n + terms"))
    groups = cut(groups.select("lang", "source", "terms", "total", F.expr("lang_n + terms").alias("lang_total")))
    groups = sent_if_small(groups, 100)
    found, _ = stored(scored(cells.join(groups, ["lang", "source"]), n, ranks))
    terms = found.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    first = lambda rows: rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    )
    out = first(_pairs(groups, found)).withColumn("part", F.lit("pair"))
    out = out.unionByName(first(terms).where(F.col("rank") <= ranks).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL
), big AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(big.n, 0) + v.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v))::BIGINT AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN big ON big.lang = g.lang AND big.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM m WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM out
) WHERE part = 'pair' OR rank <= 200
"""
