"""URL filter: rules first, then a path-template tree per host judged by smoothed labelled purity.

Paths are split into segments; those that look like numbers or keys are variable from the start.
Distinct (host, path) pairs with their counts, not rows, then go down the tree level by level; the
last level takes all that lies deeper as one segment, so whole paths are read in a fixed number of
levels. Each level is written before the next reads it. At a node these children become one
wildcard branch:

* of many children, the rare ones, unlabelled ones apart from labelled ones;
* labelled children whose rejection rate does not differ significantly from the node's;
* unlabelled children of LEAST rows or more that go on as the node's labelled children do: neither
  the share of rows that end there nor that of rows followed by a variable segment differs
  significantly.

Labels are the verdicts of the rules. A template's share of rejected labels is smoothed towards its
host's, and that towards the whole table's. It is rejected where that purity reaches `reject` and
it holds labelled rows, its own or those of branches merged into it: a url without a rule follows
labelled urls of the same make on its host, and one without such company stays.

A null url or one without `://` has an empty host and path and is judged like any other host.
Repeated urls count as often as they occur. Rules of equal length do not fit one url with different
verdicts unless they are the same; the one listed last wins then. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Levels of single segments; one more level takes the rest of a longer path as one segment.
LEVELS = 4
#: A node with more children than this is looked at for wildcards; a child is rare below this share of rows.
BRANCHES, RARE = 16, 0.05
#: Pseudo-labels of the prior, the rejected share from which a template goes, and the merging test's deviations.
PRIOR, REJECT, DEVIATIONS = 4.0, 0.8, 1.96
#: Fewest rows on either side of a comparison of unlabelled with labelled branches.
LEAST = 5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment, or its shape where it is a number or a key with digits, with its extension kept."""
    digits = F.regexp_replace(segment, r"^\d+(\.[A-Za-z]{1,5})?$", "{n}$1")
    keys = F.regexp_replace(digits, r"^(?=[^{]*\d)[0-9A-Za-z_-]{8,}(\.[A-Za-z]{1,5})?$", "{k}$1")
    return keys


def segments_of(path: Column, levels: int = LEVELS) -> Column:
    """Shaped segments of a whole path: `levels` single ones, then the rest as one."""
    all_ = F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), shape)
    rest = F.array_join(F.slice(all_, levels + 1, F.greatest(F.size(all_), F.lit(1))), "/")
    return F.when(F.size(all_) > levels, F.concat(F.slice(all_, 1, levels), F.array(rest))).otherwise(all_)


def _differs(hits: Column, n: Column, all_hits: Column, all_n: Column) -> Column:
    """Whether the shares hits / n and all_hits / all_n differ by more than DEVIATIONS standard errors of their pooled share."""
    pooled = (hits + all_hits + 0.5) / (n + all_n + 1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(all_n, F.lit(1))))
    return F.abs(hits / F.greatest(n, F.lit(1)) - all_hits / F.greatest(all_n, F.lit(1))) > DEVIATIONS * error


def templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, segments, template) of distinct (host, segments, n, rejected, labelled) rows."""
    now = paths.withColumn("template", F.array().cast("array<string>"))
    col = F.col
    for level in range(levels + 1):
        child = F.when(F.size("segments") > level, F.element_at("segments", level + 1)).otherwise(F.lit(""))
        ends = F.when(F.size("segments") <= level + 1, col("n")).otherwise(0)
        follows = F.when(F.size("segments") > level + 1, F.when(F.element_at("segments", F.least(F.size("segments"), F.lit(level + 2))).startswith("{"), col("n"))).otherwise(0)
        now = now.withColumns({"child": child, "ends": ends, "varies": F.coalesce(follows, F.lit(0))})
        per = now.groupBy("host", "template", "child").agg(*(F.sum(c).alias(c) for c in ("n", "rejected", "labelled", "ends", "varies")))
        known = lambda c: F.sum(F.when((col("labelled") > 0) & (col("child") != ""), col(c)).otherwise(0)).alias(f"known_{c}")
        node = per.groupBy("host", "template").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "rejected", "labelled")), *(known(c) for c in ("n", "ends", "varies")))
        both = per.join(node, ["host", "template"])
        rate = (col("all_rejected") + 0.5) / (col("all_labelled") + 1)
        error = F.sqrt(rate * (1 - rate) / F.greatest(col("labelled"), F.lit(1)))
        alike = (col("labelled") > 0) & (F.abs(col("rejected") / F.greatest(col("labelled"), F.lit(1)) - rate) <= DEVIATIONS * error)
        like = (col("labelled") == 0) & (col("n") >= LEAST) & (col("known_n") >= LEAST)
        for c in ("ends", "varies"):
            like = like & ~_differs(col(c), col("n"), col(f"known_{c}"), col("known_n"))
        rare = (col("children") > BRANCHES) & (col("n") < RARE * col("all_n")) & ((col("labelled") > 0) == (col("all_labelled") > 0))
        wild = (col("child") != "") & (col("children") > 1) & (rare | alike | like)
        step = both.select("host", "template", "child", F.when(wild, WILD).otherwise(col("child")).alias("kept"))
        now = now.join(step, ["host", "template", "child"])
        longer = F.when(col("kept") == "", col("template")).otherwise(F.concat("template", F.array("kept")))
        now = written(now.withColumn("template", longer).drop("child", "kept", "ends", "varies"), "tree")
    return now


_OWN = ("host", "path", "rule", "template", "verdict", "tree_verdict")


def judged(pages: DataFrame, rules=RULES, url: str = "url", levels: int = LEVELS, learn: Column | None = None) -> DataFrame:
    """All columns of `pages` with host, path, rule, template, verdict and tree_verdict; a column of such a name is replaced.

    `learn` marks the rows whose rule is a label (all); tree_verdict is what the template says, also where a rule decides.
    """
    own = [c for c in pages.columns if c.lower() not in _OWN]
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"__host": host, "__path": path, "__learn": F.lit(True) if learn is None else learn})
    rows = rows.select(*own, "__learn", F.col("__host").alias("host"), F.col("__path").alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__by_rule": verdict, "__segments": segments_of(F.col("path"), levels)})
    label = F.when(F.col("__learn"), F.col("__by_rule"))
    paths = rows.groupBy("host", F.col("__segments").alias("segments")).agg(F.count("*").alias("n"), F.count_if(label == "block").alias("rejected"), F.count(label).alias("labelled"))
    paths = written(paths, "paths")
    tree = templates(paths, levels)
    smooth = lambda r, n, prior: (F.col(r) + PRIOR * F.col(prior)) / (F.col(n) + PRIOR)
    hosts = paths.groupBy("host").agg(F.sum("rejected").alias("hr"), F.sum("labelled").alias("hl"))
    table = paths.agg(((F.coalesce(F.sum("rejected"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("prior"))
    hosts = hosts.join(F.broadcast(table)).select("host", smooth("hr", "hl", "prior").alias("prior"))  # the table's share is one row
    purity = tree.groupBy("host", "template").agg(F.sum("rejected").alias("r"), F.sum("labelled").alias("l")).join(hosts, "host")
    purity = purity.select("host", "template", "l", smooth("r", "l", "prior").alias("purity"))
    known = tree.join(purity, ["host", "template"]).select("host", F.col("segments").alias("__segments"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.col("l").alias("__l"), F.col("purity").alias("__purity"))
    out = rows.join(known, ["host", "__segments"], "left")
    by_tree = F.when((F.col("__l") > 0) & (F.col("__purity") >= REJECT), "block").otherwise("allow")
    return out.select(*own, "host", "path", "rule", "template", F.coalesce("__by_rule", by_tree).alias("verdict"), by_tree.alias("tree_verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def _oracle() -> str:
    """The same rows in DuckDB: one common table per step, the levels written out."""
    by_length = sorted(RULES, key=lambda r: -len(r[1]))
    tests = []
    for what, rule in by_length:
        of, slash, rest = rule.partition("/")
        tests.append((f"(host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash + rest}')", rule, what))
    case = lambda i: "CASE " + " ".join(f"WHEN {t[0]} THEN '{t[i]}'" for t in tests) + " END"
    number, keyed = r"^\d+(\.[A-Za-z]{1,5})?$", r"^[0-9A-Za-z_-]{8,}(\.[A-Za-z]{1,5})?$"
    steps = [
        "u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages)",
        f"v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"w AS (SELECT *, {case(1)} AS rule, {case(2)} AS by_rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS cut FROM v)",
        f"x AS (SELECT *, list_transform(cut, lambda s: CASE WHEN regexp_matches(s, '{number}') THEN '{{n}}' || regexp_extract(s, '{number}', 1) WHEN regexp_matches(s, '{keyed}') AND regexp_matches(s, '[0-9]') THEN '{{k}}' || regexp_extract(s, '{keyed}', 1) ELSE s END) AS whole FROM w)",
        f"y AS (SELECT *, CASE WHEN len(whole) > {LEVELS} THEN list_append(whole[1:{LEVELS}], array_to_string(whole[{LEVELS + 1}:], '/')) ELSE whole END AS segments FROM x)",
        "l0 AS (SELECT host, segments, count(*) AS n, count(*) FILTER (by_rule = 'block') AS rejected, count(by_rule) AS labelled, []::VARCHAR[] AS template FROM y GROUP BY host, segments)",
    ]
    def differs(hits: str, n: str, known: str) -> str:
        pooled = f"(({hits} + {known} + 0.5::DOUBLE) / (n + kn + 1))"
        return f"(abs({hits} / n::DOUBLE - {known} / greatest(kn, 1)::DOUBLE) > {DEVIATIONS}::DOUBLE * sqrt({pooled} * (1 - {pooled}) * (1 / n::DOUBLE + 1 / greatest(kn, 1)::DOUBLE)))"

    for k in range(LEVELS + 1):
        rare = f"(children > {BRANCHES} AND n < {RARE}::DOUBLE * an AND (labelled > 0) = (al > 0))"
        alike = f"(labelled > 0 AND abs(rejected / greatest(labelled, 1)::DOUBLE - rate) <= {DEVIATIONS}::DOUBLE * sqrt(rate * (1 - rate) / greatest(labelled, 1)))"
        like = f"(labelled = 0 AND n >= {LEAST} AND kn >= {LEAST} AND NOT {differs('ends', 'n', 'ke')} AND NOT {differs('varies', 'n', 'kv')})"
        known = "FILTER (labelled > 0 AND child <> '')"
        steps += [
            f"c{k} AS (SELECT *, CASE WHEN len(segments) > {k} THEN segments[{k + 1}] ELSE '' END AS child, CASE WHEN len(segments) <= {k + 1} THEN n ELSE 0 END AS ends, CASE WHEN len(segments) > {k + 1} AND starts_with(segments[{k + 2}], '{{') THEN n ELSE 0 END AS varies FROM l{k})",
            f"p{k} AS (SELECT host, template, child, sum(n) AS n, sum(rejected) AS rejected, sum(labelled) AS labelled, sum(ends) AS ends, sum(varies) AS varies FROM c{k} GROUP BY host, template, child)",
            f"q{k} AS (SELECT *, count(*) OVER o AS children, sum(n) OVER o AS an, (sum(rejected) OVER o + 0.5::DOUBLE) / (sum(labelled) OVER o + 1) AS rate, sum(labelled) OVER o AS al, "
            f"coalesce(sum(n) {known} OVER o, 0) AS kn, coalesce(sum(ends) {known} OVER o, 0) AS ke, coalesce(sum(varies) {known} OVER o, 0) AS kv FROM p{k} WINDOW o AS (PARTITION BY host, template))",
            f"s{k} AS (SELECT host, template, child, CASE WHEN child <> '' AND children > 1 AND ({rare} OR {alike} OR {like}) THEN '{WILD}' ELSE child END AS kept FROM q{k})",
            f"l{k + 1} AS (SELECT host, segments, n, rejected, labelled, CASE WHEN kept = '' THEN template ELSE list_append(template, kept) END AS template FROM c{k} JOIN s{k} USING (host, template, child))",
        ]
    last = LEVELS + 1
    steps += [
        "pr AS (SELECT (coalesce(sum(rejected), 0) + 1) / (coalesce(sum(labelled), 0) + 2)::DOUBLE AS prior FROM l0)",
        f"ph AS (SELECT host, (sum(rejected) + {PRIOR}::DOUBLE * any_value(prior)) / (sum(labelled) + {PRIOR}::DOUBLE) AS prior FROM l0, pr GROUP BY host)",
        f"pu AS (SELECT host, template, sum(labelled) AS l, (sum(rejected) + {PRIOR}::DOUBLE * any_value(prior)) / (sum(labelled) + {PRIOR}::DOUBLE) AS purity FROM l{last} JOIN ph USING (host) GROUP BY host, template)",
        f"z AS (SELECT page_id, y.host AS host, path, rule, by_rule, '/' || array_to_string(t.template, '/') AS template, CASE WHEN l > 0 AND purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END AS tree_verdict FROM y JOIN l{last} t ON t.host = y.host AND t.segments = y.segments JOIN pu ON pu.host = t.host AND pu.template = t.template)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT page_id, host, path, rule, template, coalesce(by_rule, tree_verdict) AS verdict, tree_verdict FROM z"


OP9_SQL = _oracle()
