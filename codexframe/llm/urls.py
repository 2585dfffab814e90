"""URL filters by rules and by a tree of path templates.

Explicit rules label the pages they fit. All pages build a tree a host, as deep as its paths: segments with digits, and
segments of a level with many values but few pages a value, become wildcards. Branches whose labels do not differ
significantly from their host's are merged with it, and a template is rejected by its smoothed share of blocked labels,
where each level is smoothed towards the level above: template, the longer prefixes of it that differ from the ones
above, branch, the same first segment on all hosts, all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import materialize

#: Values beyond which a level can be variable, and pages a value below which it is.
FANOUT, PAGES_A_VALUE = 16, 4
#: Weight of the level above in labels; squared deviation (95 %) beyond which a branch keeps its own statistics.
PRIOR, CHI2 = 4, 3.84


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (a host, then a path) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """The path with its segments that have digits as wildcards."""
    return F.array_join(F.transform(F.split(path, "/"), lambda own: F.when(own.rlike("[0-9]"), F.lit("*")).otherwise(own)), "/")


def _segment(number: int) -> Column:
    """A cell's segment of that number, blank beyond its path."""
    return F.split_part(F.col("segments"), F.lit("/"), F.lit(number + 1))


def _generalised(cells: DataFrame, above: list[str], number: int) -> DataFrame:
    """cells with w, their segment of that number, as a wildcard where the level is variable below those columns."""
    own = cells.withColumn("s", _segment(number))
    values = own.groupBy(*above, "s").agg(F.sum("n").alias("n")).groupBy(*above)
    wide = values.agg(((F.count("*") > FANOUT) & (F.sum("n") < PAGES_A_VALUE * F.count("*"))).alias("wide"))
    own = own.join(wide, above)
    return own.withColumn("w", F.when(F.col("wide") & (F.col("s") != ""), F.lit("*")).otherwise(F.col("s"))).drop("s", "wide")


def _groups(cells: DataFrame, by: list[str], number: int) -> DataFrame:
    """Labels of all groups of cells, and whether a level below can differ: mixed labels, and paths that go on apart."""
    rest = F.slice(F.split("segments", "/"), number + 2, 1 << 30)
    found = cells.groupBy(*by).agg(F.sum("l").alias("l1"), F.sum("b").alias("b1"), (F.min(rest) != F.max(rest)).alias("apart"))
    return found.select(*by, "l1", "b1", (F.col("apart") & (F.col("b1") > 0) & (F.col("b1") < F.col("l1"))).alias("open"))


def _smoothed(blocked: str, labels: str, prior: Column) -> Column:
    return (F.col(blocked) + PRIOR * prior) / (F.col(labels) + PRIOR)


def _differs(b: str, l: str, b_up: str, l_up: str) -> Column:
    """Whether a share of blocked labels lies significantly off the share one level up."""
    up, own = F.try_divide(b_up, l_up), F.try_divide(b, l)
    return F.coalesce((F.col(l) > 0) & ((own - up) * (own - up) * F.col(l) > CHI2 * up * (1 - up)), F.lit(False))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Judge every page (page_id, url) by rules [(host/path, "allow" or "block")], else by templates learned from them.

    Returns a row per row: page_id, host, path, rule (or null), verdict. A null url, or one without "://", has an
    empty host and path and is judged like any template. A share of one half allows, so that no page is blocked where no
    rule fits any. Repeated rows count as often as they come; a null page_id
    stays; other columns are ignored; an empty table gives no rows. Built from DataFrame functions only.
    """
    verdicts = dict(rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    rows = rows.withColumn("ruled", by_rule).withColumn("segments", _segments(F.col("path")))

    cells = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("l"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
    cells = materialize(_generalised(cells, ["host"], 1), "url_cells")
    branches = _groups(cells, ["host", "w"], 1)
    hosts = branches.groupBy("host").agg(F.sum("l1").alias("l0"), F.sum("b1").alias("b0"))
    branches = branches.join(hosts, "host").withColumn("own1", _differs("b1", "l1", "b0", "l0"))
    merged = branches.groupBy("host").agg(F.sum(F.when(F.col("own1"), 0).otherwise(F.col("l1"))).alias("lm"), F.sum(F.when(F.col("own1"), 0).otherwise(F.col("b1"))).alias("bm"))
    everywhere = branches.groupBy("w").agg(F.sum("l1").alias("lw"), F.sum("b1").alias("bw"))
    overall = everywhere.agg(((F.sum("bw") + 1) / (F.sum("lw") + 2)).alias("q0"))
    everywhere = everywhere.join(F.broadcast(overall)).withColumn("q1", _smoothed("bw", "lw", F.col("q0")))  # one row
    branches = branches.join(merged, "host").join(everywhere.select("w", "q1"), "w")
    branches = branches.withColumn("lb", F.when(F.col("own1"), F.col("l1")).otherwise(F.col("lm"))).withColumn("bb", F.when(F.col("own1"), F.col("b1")).otherwise(F.col("bm")))
    branches = branches.select("host", "w", "l1", "b1", "open", _smoothed("bb", "lb", F.col("q1")).alias("q"))
    cells = materialize(cells.join(branches, ["host", "w"]).withColumnsRenamed({"w": "prefix", "l1": "lr", "b1": "br"}), "url_level")

    # lr, br: labels of the longest prefix so far that has its own statistics, q its share
    learned, number = cells.where("not open").select("host", "segments", "q"), 1
    while not (cells := cells.where("open").drop("open")).isEmpty():
        number += 1
        cells = _generalised(cells, ["host", "prefix"], number)
        cells = cells.join(_groups(cells, ["host", "prefix", "w"], number), ["host", "prefix", "w"]).withColumn("own", _differs("b1", "l1", "br", "lr"))
        kept = [F.when(F.col("own"), F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("l1", "lr"), ("b1", "br"))]
        share = F.when(F.col("own"), _smoothed("b1", "l1", F.col("q"))).otherwise(F.col("q")).alias("q")
        cells = materialize(cells.select("host", F.concat_ws("/", "prefix", "w").alias("prefix"), "segments", "n", "l", "b", *kept, share, "open"), "url_level")
        learned = learned.union(cells.where("not open").select("host", "segments", "q"))

    learned = learned.select("host", "segments", F.when(F.col("q") > 0.5, F.lit("block")).otherwise(F.lit("allow")).alias("learned"))
    out = rows.join(learned, ["host", "segments"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"))
