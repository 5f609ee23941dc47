"""Query and SQL of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .url_filter import judge

#: Fixed values of the contract: (host, path, decision).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and component of all pages."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, decision string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).withColumnRenamed("id", "page_id")


SQL = r"""
WITH RECURSIVE rules(rh, rp, decision) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT page_id, url, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h0,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
q AS (SELECT *, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
a AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path || regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) END AS address FROM q),
t AS (
  SELECT address AS a, url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM a WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND contains(url, '://')),
g AS (
  SELECT a, url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) END AS target
  FROM t),
r AS (
  SELECT a, url, target, regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS query,
    CASE WHEN starts_with(target, '/') THEN regexp_extract(target, '(?s)^([^?#]*)', 1)
    ELSE coalesce(nullif(regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1), ''), '/') || regexp_extract(target, '(?s)^([^?#]*)', 1) END AS whole
  FROM (SELECT a, url, replace(target, '&amp;', '&') AS target FROM g)),
d AS (
  SELECT *, list_reduce(list_filter(string_split(whole, '/')[2:], lambda x: x <> '.'), lambda k, x: CASE WHEN x = '..' THEN regexp_replace(k, '(?s)/[^/]*$', '') ELSE k || '/' || x END, '')
    || CASE WHEN regexp_matches(whole, '/\.\.?$') THEN '/' ELSE '' END AS plain
  FROM r),
f AS (
  SELECT a, CASE WHEN target = '' OR starts_with(target, '#') THEN NULL
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN starts_with(target, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || target
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || plain || query END AS u
  FROM d),
e AS (
  SELECT a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS b
  FROM f WHERE contains(u, '://')),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
w(node, other) AS (SELECT a, a FROM s UNION SELECT w.node, s.b FROM w JOIN s ON w.other = s.a),
c AS (SELECT node, min(other) AS component FROM w GROUP BY node),
m AS (
  SELECT k, rh || rp AS rule, decision FROM (
    SELECT k, rh, rp, decision, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC, decision) AS n
    FROM (SELECT address AS k, host, path FROM a WHERE address IS NOT NULL UNION SELECT node, regexp_extract(node, '(?s)^([^/?#]*)', 1), regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) FROM c)
    JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) WHERE n = 1),
b AS (
  SELECT component, max(CASE WHEN decision = 'block' THEN 1 ELSE 0 END) > max(CASE WHEN decision = 'allow' THEN 1 ELSE 0 END) AS blocked
  FROM c JOIN m ON c.node = m.k GROUP BY component)
SELECT a.page_id, a.host, a.path, m.rule, coalesce(m.decision, CASE WHEN b.blocked THEN 'block' END, 'allow') AS verdict, c.component
FROM a LEFT JOIN m ON a.address = m.k LEFT JOIN c ON a.address = c.node LEFT JOIN b ON c.component = b.component
"""
