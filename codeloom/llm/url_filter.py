"""URL filters: host-suffix and path-prefix expressions, matched by hash prefix and then by full digest.

A rule is (host, path, action). It fits a URL if the URL's host is the rule's host or a subdomain of it and the URL's
path starts with the rule's path. The longest rule string wins; of equal rule strings with different actions, block wins.

Each URL is expanded into the expressions that some rule could equal: one for each number of host labels and each path
length that occur among the rules. An expression meets the rules in an equi-join on the first 32 bits of its SHA-256
digest; the whole digest then confirms the hit.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; repeated rows stay, each with
its own verdict; an empty table gives an empty result; other columns of the input are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, small

#: Hexadecimal digits of a digest that the join compares first.
SHORT = 8
#: The verdict where no rule fits.
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: its id, host, path, the rule that decides (or null) and the verdict."""
    rules = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("action")
    ).withColumn("rule", F.concat("host", "path"))
    # The distinct shapes are few whatever the number of rules: label counts times path lengths.
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    keyed = rules.select(
        F.sha2(F.col("rule"), 256).alias("_digest"), F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("b"), F.col("rule").alias("rule"), F.col("action").alias("action")).alias("_hit")
    ).groupBy("_digest").agg(F.max("_hit").alias("_hit")).withColumn("_short", F.substring("_digest", 1, SHORT))
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = urls.withColumns({"_host": url_host(F.col("_url")), "_path": url_path(F.col("_url"))}).withColumn("_labels", F.split("_host", r"\."))
    # The shapes are one literal array, so the plan does not grow with the rules.
    codes = F.lit([s.labels << 32 | s.chars for s in shapes]).cast("array<long>") if shapes else F.array().cast("array<long>")

    def form(code: Column) -> Column:
        labels, chars = F.shiftright(code, 32).cast("int"), code.bitwiseAND(0xFFFFFFFF).cast("int")
        fits = (F.size("_labels") >= labels) & (F.length("_path") >= chars) & (F.col("_host") != "")
        return F.when(fits, F.concat(F.array_join(F.slice("_labels", -labels, labels), "."), F.substring(F.col("_path"), F.lit(1), chars)))

    # Entry 0 is null, so that each row stays even if it has no expression; it also counts the rows that are equal.
    # The digests are made after the explode: in a left join's condition they would be computed twice.
    exprs = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(codes, form), lambda x: x.isNotNull()))
    wide = urls.select("_id", "_url", F.posexplode(exprs).alias("_pos", "_expr")).withColumn("_full", F.sha2(F.col("_expr"), 256))
    wide = wide.withColumn("_key", F.substring("_full", 1, SHORT))
    rules_side = small(keyed)
    met = wide.join(rules_side, (F.col("_key") == F.col("_short")) & (F.col("_full") == F.col("_digest")), "left")
    # Map-side aggregation leaves one row for each URL row of a task before the shuffle.
    won = met.groupBy("_id", "_url").agg(F.max("_hit").alias("_hit"), F.count(F.when(F.col("_pos") == 0, 1)).alias("_n"))
    out = won.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(
        F.col("_id").alias(id_col), url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"),
        F.col("_hit.rule").alias("rule"), F.coalesce("_hit.action", F.lit(DEFAULT)).alias("verdict"),
    )


#: The rules of the registered query: host, path, action.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


SQL = """
WITH rules(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS rn,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, rn,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
m AS (SELECT q.rn, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, action := r.action)) AS hit
  FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.rn)
SELECT q.page_id, q.host, q.path, m.hit.rule AS rule, coalesce(m.hit.action, 'allow') AS verdict
FROM q LEFT JOIN m ON q.rn = m.rn
"""
