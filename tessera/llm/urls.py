"""URL filter: rules first, then a path-template tree with smoothed labelled purity. DataFrame operations alone.

A template is a path prefix whose variable segments are ``*``. A node of the tree is a host, or a branch of a node: its
urls parted by their next segment. A segment is variable if it holds a digit, or if its node has more than
``MAX_LITERALS`` distinct ones and fewer than ``RARE`` urls have this one. Segments whose labelled shares don't differ
from their node's by a two-proportion test, and segments without labels, are one merged branch; those that differ are
merged with the ones of like share (by tenths). A branch's share of blocked labels is smoothed toward its node's, up to
the host's, the top-level domain's and all urls'. Only nodes that hold both labels are parted further, as deep as their
paths go: below a node of one label nothing could change a verdict. Labels are the rules' verdicts, so urls that no rule
fits are judged by what is labelled beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MAX_LITERALS = 50
RARE = 5
#: Labels that the parent's share counts for.
STRENGTH = 5.0
#: Blocked share from which a template is rejected.
REJECT = 0.5
#: Standard errors within which a segment is like its node.
ALIKE = 1.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null."""
    fits = [
        F.when(((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(*fits, none, none)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share of every row of ``pages``.

    template is the path as far as the tree parts it, share its smoothed share of blocked labels. Null urls and urls
    without ``://`` have empty host and path. Rows that repeat are judged alike; a share that ties with REJECT, as
    without any label, is allowed. An empty table gives an empty result. Other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.array_join(parts, "/"))
    counts = [F.sum(c).alias(c) for c in ("n", "k", "b")]
    blocked = F.count_if(F.col("fit.verdict") == "block").alias("b")
    tree = materialize(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("fit").alias("k"), blocked), "urls")

    def smooth(share: Column, k: Column | str = "k", b: Column | str = "b") -> Column:
        return (F.col(b) + F.lit(STRENGTH) * share) / (F.col(k) + F.lit(STRENGTH))

    def mixed(k: str, b: str) -> Column:
        return (F.col(b) > 0) & (F.col(b) < F.col(k))

    hosts = tree.groupBy("host").agg(*counts[1:]).withColumn("tld", F.substring_index("host", ".", -1))
    every = hosts.agg(*counts[1:]).first()
    above = ((every.b or 0) + STRENGTH * REJECT) / ((every.k or 0) + STRENGTH)
    tlds = hosts.groupBy("tld").agg(*counts[1:]).select(F.col("tld").alias("t_tld"), smooth(F.lit(above)).alias("t_share"))
    hosts = hosts.join(tlds, F.col("tld") == F.col("t_tld")).select(F.col("host").alias("h_host"), smooth(F.col("t_share")).alias("share"), mixed("k", "b").alias("more"))
    state = tree.join(hosts, F.col("host") == F.col("h_host")).select("host", "shape", "n", "k", "b", F.col("host").alias("node"), F.col("host").alias("template"), "share", "more")
    state, done, level = materialize(state, "urls"), [], 0
    while True:
        done.append(state.where("not more").select("host", "shape", "template", "share"))
        state = state.where("more")
        if not state.limit(1).count():
            break
        state = state.withColumn("seg", F.coalesce(F.try_element_at(F.split("shape", "/"), F.lit(level + 1)), F.lit("")))
        kids = state.groupBy("node", "seg").agg(*counts, F.max("share").alias("share"))
        nodes = kids.groupBy(F.col("node").alias("n_node")).agg(F.count(F.lit(1)).alias("kids"), F.sum("k").alias("all_k"), F.sum("b").alias("all_b"))
        kids = kids.join(nodes, F.col("node") == F.col("n_node"))
        literal = F.when((F.col("seg") != "") & (F.col("kids") > MAX_LITERALS) & (F.col("n") < RARE), "*").otherwise(F.col("seg"))
        kids = materialize(kids.select("node", "seg", literal.alias("literal"), "n", "k", "b", "share", "all_k", "all_b"), "segments")
        p, pool = (F.col("b") + 0.5) / (F.col("k") + 1.0), (F.col("all_b") + 0.5) / (F.col("all_k") + 1.0)
        error = F.sqrt(p * (1 - p) / (F.col("k") + 1.0) + pool * (1 - pool) / (F.col("all_k") + 1.0))
        like = (F.col("k") == 0) | (F.abs(p - pool) <= F.lit(ALIKE) * error)
        merged = kids.groupBy("node", "literal").agg(*counts[1:], *(F.max(c).alias(c) for c in ("share", "all_k", "all_b")))
        merged = materialize(merged.withColumn("branch", F.when(like, "=").otherwise(F.floor(p * 10).cast("string"))), "segments")
        branches = merged.groupBy(F.col("node").alias("b_node"), F.col("branch").alias("b_branch")).agg(*counts[1:], F.max("share").alias("share"))
        branches = branches.select("b_node", "b_branch", smooth(F.col("share")).alias("new_share"), mixed("k", "b").alias("new_more"))
        merged = merged.join(branches, (F.col("node") == F.col("b_node")) & (F.col("branch") == F.col("b_branch")))
        merged = merged.select(F.col("node").alias("m_node"), F.col("literal").alias("m_literal"), "branch", "new_share", "new_more")
        kids = kids.join(merged, (F.col("node") == F.col("m_node")) & (F.col("literal") == F.col("m_literal")))
        kids = kids.select(F.col("node").alias("k_node"), F.col("seg").alias("k_seg"), "literal", "branch", "new_share", "new_more")
        state = state.join(kids, (F.col("node") == F.col("k_node")) & (F.col("seg") == F.col("k_seg")))
        template = F.concat("template", F.when(F.col("seg") == "", "").otherwise(F.concat(F.lit("/"), "literal")))
        state = state.select("host", "shape", "n", "k", "b", F.concat("node", F.lit("/"), "branch").alias("node"), template.alias("template"), F.col("new_share").alias("share"), (F.col("new_more") & (F.col("seg") != "")).alias("more"))
        state, level = materialize(state, "urls"), level + 1
    verdicts = reduce(DataFrame.union, done).select(F.col("host").alias("v_host"), F.col("shape").alias("v_shape"), "template", "share")
    if len(done) > 1:
        verdicts = materialize(verdicts, "templates")
    out = rows.join(verdicts, (F.col("host") == F.col("v_host")) & (F.col("shape") == F.col("v_shape")))
    judged = F.when(F.col("share") > REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", judged).alias("verdict"), "template", F.round("share", 6).alias("share"))


def _case(of: str) -> str:
    longest = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if of == 'rule' else v}'" for h, p, v in longest) + " END"


#: The same relation for DuckDB: a level of the tree is a step of the recursion, its groups are windows.
URLS_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, {_case("rule")} AS rule, {_case("verdict")} AS said,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END), '/') AS shape FROM cut),
shapes AS (SELECT host, shape, regexp_extract(host, '[^.]*$') AS tld, count(*) AS n, count(rule) AS k, count(*) FILTER (said = 'block') AS b FROM ruled GROUP BY ALL),
summed AS (
  SELECT *, sum(k) OVER () AS k0, sum(b) OVER () AS b0, sum(k) OVER t AS k1, sum(b) OVER t AS b1, sum(k) OVER h AS k2, sum(b) OVER h AS b2
  FROM shapes WINDOW t AS (PARTITION BY tld), h AS (PARTITION BY host)),
tree AS (
  SELECT 0 AS lvl, host, shape, n, k, b, host AS node, host AS template,
    (b2 + {STRENGTH} * ((b1 + {STRENGTH} * ((b0 + {STRENGTH}::DOUBLE * {REJECT}) / (k0 + {STRENGTH}))) / (k1 + {STRENGTH}))) / (k2 + {STRENGTH}) AS share, b2 > 0 AND b2 < k2 AS more
  FROM summed
  UNION ALL
  SELECT lvl + 1, host, shape, n, k, b, node || '/' || branch, template || CASE WHEN seg = '' THEN '' ELSE '/' || literal END,
    (sum(b) OVER w + {STRENGTH}::DOUBLE * share) / (sum(k) OVER w + {STRENGTH}::DOUBLE), sum(b) OVER w > 0 AND sum(b) OVER w < sum(k) OVER w AND seg <> ''
  FROM (
    SELECT *, CASE WHEN lk = 0 OR abs((lb + 0.5::DOUBLE) / (lk + 1.0::DOUBLE) - (nb + 0.5::DOUBLE) / (nk + 1.0::DOUBLE)) <= {ALIKE} * sqrt(
        (lb + 0.5::DOUBLE) / (lk + 1.0::DOUBLE) * (1 - (lb + 0.5::DOUBLE) / (lk + 1.0::DOUBLE)) / (lk + 1.0::DOUBLE)
        + (nb + 0.5::DOUBLE) / (nk + 1.0::DOUBLE) * (1 - (nb + 0.5::DOUBLE) / (nk + 1.0::DOUBLE)) / (nk + 1.0::DOUBLE)) THEN '='
      ELSE floor((lb + 0.5::DOUBLE) / (lk + 1.0::DOUBLE) * 10)::INT::VARCHAR END AS branch
    FROM (
      SELECT *, sum(k) OVER l AS lk, sum(b) OVER l AS lb, sum(k) OVER (PARTITION BY node) AS nk, sum(b) OVER (PARTITION BY node) AS nb
      FROM (
        SELECT *, CASE WHEN seg <> '' AND max(place) OVER (PARTITION BY node) > {MAX_LITERALS} AND sum(n) OVER (PARTITION BY node, seg) < {RARE} THEN '*' ELSE seg END AS literal
        FROM (
          SELECT *, dense_rank() OVER (PARTITION BY node ORDER BY seg) AS place
          FROM (SELECT *, coalesce(string_split(shape, '/')[lvl + 1], '') AS seg FROM tree WHERE more)))
      WINDOW l AS (PARTITION BY node, literal)))
  WINDOW w AS (PARTITION BY node, branch)),
last AS (SELECT host, shape, arg_max(template, lvl) AS template, arg_max(share, lvl) AS share FROM tree GROUP BY host, shape)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN share > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(share, 6) AS share
FROM ruled JOIN last USING (host, shape)
"""
