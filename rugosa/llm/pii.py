"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seeds: the
word before a seed, the word after it, and both together, each with whether a name or a number
stands there, make lexical patterns, and all identifier-like strings of the corpus, seeds or not, are
the instances that patterns extract.
Pattern confidence and instance confidence are scored against one another over the graph of
pattern-instance pairs for a few rounds, and instances that confident patterns extract are added
as spans of the kind that the pattern's seeds have.

Offsets count code points. The patterns are written so that they match exactly what
EMAIL/IP/CARD/PHONE below say, in time linear in the text: runs are possessive, and a match starts
at a run's beginning or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The kinds, in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: identifier-like strings: digits with separators of any kind, or a name at a host in any spelling
AT, DOT = r" ?(?:@|\[at\]|\(at\)|\{at\}) ?", r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| ?\[\.\] ?)"
NAME = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+"
CANDIDATE = NAME + r"|[+(]?[0-9][0-9() ./_:\[\]-]{5,}[0-9]"
#: stands around matches while a text is split; in texts it is replaced by another character
MARK, OTHER = "\ue000", "\ufffd"
SPAN = "struct<s:int,e:int,t:string,l:string,r:string>"


def _parts(text: Column, pattern: str, guard: Column) -> Column:
    """The text cut at its matches: they are the parts of odd index."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.when(guard, F.split(marked, MARK, -1)).otherwise(F.array(F.lit("")))


def _spans(parts: str) -> Column:
    """Of a column of `_parts`: start, end, text, and up to 40 characters on either side, of each match."""
    step = f"""named_struct('at', s.at + length({parts}[i]), 'out', if(i % 2 = 1, array_append(s.out, named_struct('s', s.at, 'e', s.at + length({parts}[i]), 't', {parts}[i], 'l', right({parts}[i - 1], 40), 'r', left({parts}[i + 1], 40))), s.out))"""
    return F.expr(f"aggregate(sequence(0, size({parts}) - 1), named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)), (s, i) -> {step}, s -> s.out)")


def _valid() -> list[str]:
    digits = "regexp_replace(x.t, '[^0-9]', '')"
    return [
        "true",
        "forall(split(x.t, '[.]'), p -> cast(p as double) <= 255)",
        f"length({digits}) between 12 and 19 and luhn_check({digits})",
        f"length({digits}) between 9 and 15",
    ]


def base_spans(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """docs with `base`: array of (s, k, e) by start, then kind; and `found`: matches of `extra`."""
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(OTHER))
    d = docs.withColumn("clean_", clean).withColumn("digit_", F.col("clean_").rlike("[0-9]"))
    at, plus = F.contains("clean_", F.lit("@")), F.contains("clean_", F.lit("+"))
    guards = (at, F.col("digit_") & F.contains("clean_", F.lit(".")), F.col("digit_"), F.col("digit_") & plus)
    d = d.select("*", *[_parts(F.col("clean_"), p, g).alias(f"p{k}_") for k, (p, g) in enumerate(zip((EMAIL, IP, CARD, PHONE), guards))], *([_parts(F.col("clean_"), extra, F.col("digit_") | at | F.contains("clean_", F.lit("at]")) | F.contains("clean_", F.lit("(at)"))).alias("px_")] if extra else []))
    d = d.select("*", *[_spans(f"p{k}_").alias(f"s{k}_") for k in range(4)], *([_spans("px_").alias("found")] if extra else []))
    kept = ", ".join(f"transform(filter(s{k}_, x -> {v}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))" for k, v in enumerate(_valid()))
    return d.withColumn("base", F.expr(f"array_sort(concat({kept}))")).drop("clean_", "digit_", "px_", *[f"{c}{k}_" for k in range(4) for c in "ps"])


def score_graph(pairs: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """pairs (instance, pattern, kind of the seed or null, n) -> confidences of patterns and of instances.

    A pattern's confidence for a kind is the mean confidence of what it extracts, by occurrences
    with one doubtful occurrence added; an instance that is no seed has 1 - prod(1 - confidence)
    of the patterns that extract it. Seeds stay at 1.
    """
    seeds = pairs.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    total = pairs.groupBy("pattern").agg(F.sum("n").alias("total"))
    edges = pairs.groupBy("instance", "pattern").agg(F.sum("n").alias("n"))
    known = seeds
    for _ in range(rounds):
        hits = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count("*").alias("instances"))
        patterns = cut(hits.join(total, "pattern").select("pattern", "kind", "instances", (F.col("hit") / (F.col("total") + 1)).alias("score")))
        more = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("score")))))).alias("score"))
        known = cut(seeds.unionByName(more.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti")))
    return patterns, known


def base_rates(pairs: DataFrame) -> DataFrame:
    """(shape, kind, rate): the share of seeds of each kind among all occurrences of a shape; a few rows."""
    every = pairs.where(F.col("pattern").startswith("before\t")).withColumn("shape", F.element_at(F.split("pattern", "\t"), -1))
    total = every.groupBy("shape").agg(F.sum("n").alias("total"))
    return every.where("kind is not null").groupBy("shape", "kind").agg(F.sum("n").alias("n")).join(total, "shape").select("shape", "kind", (F.col("n") / F.col("total")).alias("rate"))


def find_personal_data(docs: DataFrame, least: float = 0.8, support: int = 5, rounds: int = 3, keep: tuple = ("doc_id",), lift: float = 3.0) -> DataFrame:
    """`keep`, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document (doc_id, text).

    The counts and base_sha256 are those of the base patterns; spans holds these and what the
    bootstrapped patterns add, as kind:start:end by start, then kind, joined by commas. A pattern
    adds what it extracts if its confidence is >= least and at least `support` different instances
    bear it out, and if it could be of the kind (a name at a host, an address's four parts, a card's 12
    to 19 digits with a valid check digit, a phone number's 7 to 15). A pattern of numbers must also
    be wrong at most 1 / `lift` as often as any number is: where most numbers of a corpus are of one
    kind, a word that stands beside some of them says nothing. What overlaps a base span or a longer added one is not
    added. Null counts as empty and has no spans. Rows repeated with equal text get equal spans. An
    empty table gives an empty one. Columns that aren't named in `keep` are ignored.
    """
    d = base_spans(docs.select(*keep, "text"), CANDIDATE).withColumn("key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep], "text")).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    d = cut(d.select(*keep, "key", "size", "base", "found"))
    c = d.where("size(found) > 0").select("key", "size", "base", F.explode("found").alias("x"))
    clash = "exists(base, b -> b.s < x.e and b.e > x.s)"
    before = F.lower(F.regexp_extract("x.l", r"([\p{L}:=#]+)[^\p{L}]*$", 1))
    after = F.lower(F.regexp_extract("x.r", r"^[^\p{L}]*([\p{L}]+)", 1))
    shape = F.when(F.col("x.t").rlike(r"@|[(\[{]at[)\]}]"), "name").otherwise("number")
    made = F.array(F.concat_ws("\t", F.lit("before"), before, shape), F.concat_ws("\t", F.lit("after"), after, shape), F.concat_ws("\t", F.lit("both"), before, after, shape))
    c = c.select("key", "size", "x.s", "x.e", F.sha2(F.lower("x.t"), 256).alias("instance"), made.alias("patterns"), "x.t", F.try_element_at(F.expr("transform(filter(base, b -> b.s >= x.s and b.e <= x.e), b -> b.k)"), F.lit(1)).alias("kind"), F.expr(clash).alias("clash"))
    c = cut(c)
    pairs = cut(c.select("instance", F.explode("patterns").alias("pattern"), "kind").groupBy("instance", "pattern", "kind").agg(F.count("*").alias("n")))
    patterns, _ = score_graph(pairs, rounds)
    rates = F.broadcast(base_rates(pairs))  # two shapes, four kinds
    patterns = patterns.withColumn("shape", F.element_at(F.split("pattern", "\t"), -1)).join(rates, ["shape", "kind"], "left")
    telling = (F.col("shape") == "name") | (1 - F.col("score") <= (1 - F.coalesce("rate", F.lit(0.0))) / lift)
    strong = patterns.where((F.col("score") >= least) & (F.col("instances") >= support) & telling).groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("p")).select("pattern", (-F.col("p.k")).alias("k"), "p.score")
    digits = "regexp_replace(t, '[^0-9]', '')"
    parts = "filter(split(t, '[^0-9]+'), p -> p <> '')"
    fits = F.expr(f"""case k when 0 then instr(t, '@') > 0 or lower(t) rlike '[({{\\\\[]at[)}}\\\\]]' when 1 then size({parts}) = 4 and forall({parts}, p -> cast(p as double) <= 255)
        when 2 then length({digits}) between 12 and 19 and luhn_check({digits}) else length({digits}) between 7 and 15 end""")
    open_ = c.where("not clash").select("key", "size", "s", "e", "t", F.explode("patterns").alias("pattern"))
    # one span and kind for each place: that of its most confident pattern; the number of places is a text's
    kinds = open_.join(strong, "pattern").where(fits).groupBy("key", "size", "s", "e").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("p"))
    added = kinds.groupBy("key", "size").agg(F.collect_list(F.struct("s", (-F.col("p.k")).alias("k"), "e")).alias("added"))
    out = d.drop("found").join(added, ["key", "size"], "left")
    names = "element_at(array('email', 'ip', 'card', 'phone'), x.k + 1)"
    text = lambda spans: F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}, ':', x.s, ':', x.e)))")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(*keep, *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("array_sort(concat(base, coalesce(added, cast(array() as array<struct<s:int,k:int,e:int>>))))").alias("spans"))


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
