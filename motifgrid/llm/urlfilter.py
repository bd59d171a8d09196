"""URL filters: explicit rules first, then a tree of path templates for each host.

Paths are counted by host and lexical template (runs of digits and long hex strings
are variable). Level by level, children of a node whose labelled rates don't
differ from the node's (by more, if they are many and rare) merge into one wildcard branch; what
differs stays a branch of its own. Paths of any depth are followed to their ends. A template is rejected if the share of good
labels among its labelled pages, smoothed by its host's share, which is smoothed by
the share of all, is under a threshold.

Everything is DataFrame expressions: no Python runs on the executors. Pages are
counted before any shuffle by node, and the wanted verdicts come back by a join
that Spark can split where a host is hot.

Defined results: a null url, or one without `://`, has an empty host and path; a
url with an empty path is the template `/`. Repeated rows are judged alike and kept.
With no labels at all every template is allowed. An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class TemplateTree:
    """z: children whose good share is within so many standard errors of the node's merge.
    fan_out, rare, strict: a node of more children than fan_out asks those with less than this share of its
    pages for a difference of `strict` standard errors, since some of many differ by chance.
    strength: pages that the prior counts as. threshold: least smoothed good share that is allowed."""

    fan_out: int = 16
    rare: float = 0.02
    strict: float = 3.5
    z: float = 1.96
    strength: float = 2.0
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def lexical(path: Column) -> Column:
    """Segments of a path, variable parts replaced: long hex strings with a digit, then runs of digits."""
    hexes = lambda s: s.rlike("^[0-9a-f-]{8,}$") & s.rlike("[0-9]")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(hexes(s), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))


def judge_templates(paths: DataFrame, tree: TemplateTree = TemplateTree()) -> DataFrame:
    """For paths(host, lex, good): a row for each host and lexical template with its template, counts, purity and verdict.

    good is 1, 0 or null (no label); lex is an array of segments.
    """
    spark = paths.sparkSession
    counts = (F.count("*").alias("n"), F.sum("good").alias("good"), F.count("good").alias("seen"))
    rows = paths.groupBy("host", "lex").agg(*counts).withColumn("good", F.coalesce("good", F.lit(0))).withColumn("node", F.lit(""))
    rows = materialise(rows, "templates")
    most = rows.count()
    level, done = 0, []
    while True:
        # Paths that end here are done; the others go a level down, until none does.
        done.append(rows.where(F.size("lex") <= level))
        rows = rows.where(F.size("lex") > level)
        if not rows.limit(1).count():
            break
        # Two counts of the pre-aggregated rows, then joins by node: a hot host is split there.
        rows = rows.withColumn("seg", F.get("lex", F.lit(level)))
        child = rows.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(f"child_{c}") for c in ("n", "good", "seen")))
        node = child.groupBy("host", "node").agg(F.count("*").alias("children"), *(F.sum(f"child_{c}").alias(f"node_{c}") for c in ("n", "good", "seen")))
        many = (F.col("children") > tree.fan_out) & (F.col("child_n") < tree.rare * F.col("node_n"))
        share = (F.col("node_good") + 1) / (F.col("node_seen") + 2)
        error = F.sqrt(share * (1 - share) / F.greatest(F.col("child_seen"), F.lit(1)))
        alike = F.abs((F.col("child_good") + share) / (F.col("child_seen") + 1) - share) <= F.when(many, tree.strict).otherwise(tree.z) * error
        kept = child.join(node, ["host", "node"]).select("host", "node", "seg", F.when((F.col("children") > 1) & alike, "*").otherwise(F.col("seg")).alias("branch"))
        rows = rows.join(kept, ["host", "node", "seg"]).select("host", "lex", "n", "good", "seen", F.concat("node", F.lit("/"), "branch").alias("node"))
        rows = materialise(rows, f"templates-{level}", most)
        level += 1
    rows = reduce(DataFrame.unionByName, done)
    rows = rows.withColumn("template", F.when(F.col("node") == "", "/").otherwise(F.col("node"))).drop("node")
    total = rows.agg(F.sum("good").alias("all_good"), F.sum("seen").alias("all_seen"))
    host = rows.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("seen").alias("host_seen"))
    each = rows.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    found = each.join(host, "host").join(F.broadcast(total))  # one row
    of_all = (F.coalesce("all_good", F.lit(0)) + 1) / (F.coalesce("all_seen", F.lit(0)) + 1)
    of_host = (F.col("host_good") + tree.strength * of_all) / (F.col("host_seen") + tree.strength)
    purity = (F.col("good") + tree.strength * of_host) / (F.col("seen") + tree.strength)
    found = found.select("host", "template", "pages", "good", "seen", purity.alias("purity")).withColumn("verdict", F.when(F.col("purity") < tree.threshold, "block").otherwise("allow"))
    return rows.select("host", "lex", "template").join(found, ["host", "template"])


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tree: TemplateTree = TemplateTree(), labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for pages(page_id, url).

    labels(page_id, good) are the labelled pages (of a page's labels the least counts); without them the pages that a
    rule fits are: allowed ones good, blocked ones not.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"), lexical(F.col("path")).alias("lex"))
    if labels is None:
        labelled = rows.withColumn("good", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0))
    else:
        labelled = rows.join(labels.groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good")), "page_id", "left")
    judged = judge_templates(labelled.select("host", "lex", "good"), tree).select("host", "lex", "template", "purity", F.col("verdict").alias("judged"))
    return rows.join(judged, ["host", "lex"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template", "purity")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _oracle(rules: tuple[Rule, ...] = RULES, tree: TemplateTree = TemplateTree()) -> str:
    """The query as SQL, a table for each level of the tree; SQL needs their number, and the tables' paths are far shorter."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    which = lambda field: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in longest) + " END"
    parts = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"""r AS (SELECT *, {which("name")} AS rule, {which("verdict")} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
  lambda s: CASE WHEN regexp_full_match(s, '[0-9a-f-]{{8,}}') AND regexp_matches(s, '[0-9]') THEN '{{h}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS lex FROM p)""",
        "t0 AS (SELECT host, lex, '' AS node, count(*) AS n, count(CASE WHEN ruled = 'allow' THEN 1 END) AS good, count(ruled) AS seen FROM r GROUP BY ALL)",
    ]
    levels = 12
    for k in range(levels):
        parts += [
            f"c{k} AS (SELECT host, node, lex[{k + 1}] AS seg, sum(n) AS n, sum(good) AS good, sum(seen) AS seen FROM t{k} WHERE len(lex) > {k} GROUP BY ALL)",
            f"n{k} AS (SELECT host, node, count(*) AS children, sum(n) AS n, (sum(good) + 1) / (sum(seen) + 2) AS share FROM c{k} GROUP BY ALL)",
            f"""k{k} AS (SELECT host, node, seg, CASE WHEN children > 1 AND abs((good + share) / (seen + 1) - share)
  <= CASE WHEN children > {tree.fan_out} AND c.n < {tree.rare} * m.n THEN {tree.strict} ELSE {tree.z} END * sqrt(share * (1 - share) / greatest(seen, 1)) THEN '*' ELSE seg END AS branch FROM c{k} c JOIN n{k} m USING (host, node))""",
            f"t{k + 1} AS (SELECT t.host, lex, t.node || coalesce('/' || branch, '') AS node, n, good, seen FROM t{k} t LEFT JOIN k{k} b ON t.host = b.host AND t.node = b.node AND lex[{k + 1}] = seg)",
        ]
    s = tree.strength
    return "WITH " + ",\n".join(parts) + f""",
t AS (SELECT host, lex, n, good, seen, CASE WHEN node = '' THEN '/' ELSE node END AS template FROM t{levels}),
g AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(seen), 0) + 1) AS share FROM t),
h AS (SELECT host, (sum(good) + {s} * any_value(share)) / (sum(seen) + {s}) AS share FROM t, g GROUP BY host),
v AS (SELECT host, template, (sum(good) + {s} * any_value(share)) / (sum(seen) + {s}) AS purity FROM t JOIN h USING (host) GROUP BY host, template)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN purity < {tree.threshold} THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity
FROM r JOIN t USING (host, lex) JOIN v ON v.host = r.host AND v.template = t.template"""


ORACLE = {"op10_url_filters": _oracle()}
