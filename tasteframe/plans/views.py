"""The model's tables as views over the driver's test tables: one SQL text for both engines.

Words in capitals with brackets are what the engines spell differently: EPOCH(x) seconds of a timestamp, IDIV(a; b)
integer division, LIST(...) an array, EACH(n; i; e) the array of e for i from 1 to n, DAY(text; n) a date n days after.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

NOW, FIRST_CUTOFF = 1009756800, "1996-01-01"  # 2001-12-31

VIEWS = {
    "plays": """
      SELECT l_orderkey * 8 + l_linenumber AS row_id, IDIV(o_custkey; 10) AS user_id, EPOCH(l_shipdate) AS date,
        CASE WHEN l_partkey % 4 = 3 THEN 'episode' ELSE 'movie' END AS media_type, l_partkey AS rating_key,
        CASE WHEN l_partkey % 4 = 3 THEN 1000000 + IDIV(l_partkey; 4) % 50 END AS grandparent_rating_key,
        concat('Part ', CAST(l_partkey AS STRING)) AS title,
        CASE WHEN l_partkey % 4 = 3 THEN concat('Show ', CAST(IDIV(l_partkey; 4) % 50 AS STRING)) END AS grandparent_title,
        CAST(1990 + l_partkey % 12 AS INT) AS year, CAST(DAY('1990-01-01'; l_partkey * 7 % 4000) AS STRING) AS originally_available_at,
        CAST(l_quantity * 2 AS INT) AS percent_complete,
        CASE WHEN l_returnflag IN ('N', 'R') THEN CAST(1.0 AS DOUBLE) WHEN l_linenumber % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS watched_status,
        CASE l_linenumber % 4 WHEN 0 THEN 'Bravia 4K' WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Phone' END AS player,
        CASE l_suppkey % 5 WHEN 0 THEN 'Roku' WHEN 1 THEN 'roku' WHEN 2 THEN 'webOS' WHEN 3 THEN 'Linux' END AS platform,
        CASE l_suppkey % 3 WHEN 0 THEN 'Some tv app' WHEN 1 THEN 'Web' END AS product
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "titles": """
      SELECT p_partkey AS rating_key, 'movie' AS media_type, p_name AS title, CAST(1990 + p_partkey % 12 AS INT) AS year,
        CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_partkey END AS tmdb_id FROM part WHERE p_partkey % 4 != 3
      UNION ALL SELECT DISTINCT 1000000 + IDIV(p_partkey; 4) % 50, 'show', concat('Show ', CAST(IDIV(p_partkey; 4) % 50 AS STRING)), CAST(NULL AS INT),
        1000000 + IDIV(p_partkey; 4) % 50 FROM part WHERE p_partkey % 4 = 3""",
    "figures": """
      SELECT p_partkey AS tmdb_id, 'movie' AS media_type, p_name AS title, n AS parts, p_size * 6 AS runtime, count(l_partkey) * 20 AS vote_count
      FROM part CROSS JOIN (SELECT count(*) AS n FROM part) LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 4 != 3
      GROUP BY p_partkey, p_name, n, p_size
      UNION ALL SELECT 1000000 + IDIV(p_partkey; 4) % 50, 'show', concat('Show ', CAST(IDIV(p_partkey; 4) % 50 AS STRING)), max(n), max(p_size), count(l_partkey) * 20
      FROM part CROSS JOIN (SELECT count(*) AS n FROM part) LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 4 = 3
      GROUP BY 1000000 + IDIV(p_partkey; 4) % 50, concat('Show ', CAST(IDIV(p_partkey; 4) % 50 AS STRING))""",
    "items": """
      SELECT tmdb_id, media_type, vote_count >= 100 AS in_catalogue, title, CAST(DAY('1990-01-01'; tmdb_id * 7 % 4000) AS STRING) AS release_date,
        CAST(substr(CAST(DAY('1990-01-01'; tmdb_id * 7 % 4000) AS STRING), 1, 4) AS INT) AS year,
        CASE WHEN tmdb_id % 9 = 0 THEN LIST(CAST(16 AS BIGINT), CAST(10751 AS BIGINT)) WHEN tmdb_id % 11 = 0 THEN LIST(CAST(10762 AS BIGINT))
          ELSE LIST(tmdb_id % 7 + 20, tmdb_id * 3 % 5 + 30) END AS genres,
        LIST(tmdb_id % 40 + 100, tmdb_id * 7 % 40 + 100, tmdb_id * 13 % 40 + 100) AS keywords,
        LIST(tmdb_id % 100, tmdb_id * 3 % 100) AS cast, LIST(tmdb_id % 30) AS crew,
        CASE WHEN tmdb_id % 5 = 0 THEN 'fr' ELSE 'en' END AS language,
        CASE tmdb_id % 8 WHEN 0 THEN 'TV-Y' WHEN 1 THEN 'PG-13' WHEN 2 THEN 'G' WHEN 3 THEN 'R' WHEN 4 THEN 'TV-14' END AS certification,
        CASE WHEN media_type = 'movie' THEN IDIV(tmdb_id; 10) END AS collection_id, CAST(runtime AS BIGINT) AS runtime,
        CAST(5 + tmdb_id % 50 AS DOUBLE) / 10 + CAST(2 AS DOUBLE) AS vote_average, vote_count,
        CASE WHEN media_type = 'movie' THEN EACH(12; i; (tmdb_id + 4 * i * i) % (parts + 8)) ELSE EACH(6; i; 1000000 + (tmdb_id + i) % 53) END AS recommendations,
        CASE WHEN media_type = 'movie' THEN EACH(10; i; (tmdb_id + 8 * i + 4) % parts) ELSE EACH(5; i; 1000000 + (tmdb_id + 3 * i) % 50) END AS similar_ids
      FROM figures""",
    "library": """
      SELECT tmdb_id, media_type, CASE WHEN tmdb_id % 50 = 7 THEN NULL ELSE 788918400 + (tmdb_id * 37 % 2400) * 86400 END AS added_at
      FROM figures WHERE tmdb_id % 3 != 0""",
    "requests": """
      SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 200 = 0 THEN NULL ELSE IDIV(o_custkey; 10) END AS user_id,
        CASE WHEN min(l_partkey) % 4 = 3 THEN 1000000 + IDIV(min(l_partkey); 4) % 50 ELSE min(l_partkey) END AS tmdb_id,
        CASE WHEN min(l_partkey) % 4 = 3 THEN 'show' ELSE 'movie' END AS media_type, EPOCH(o_orderdate) AS created_at
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 25 = 0 GROUP BY o_orderkey, o_custkey, o_orderdate""",
    "users": "SELECT DISTINCT IDIV(c_custkey; 10) AS user_id FROM customer",
    "alias": "SELECT user_id AS member, user_id - 1 AS canonical FROM (SELECT DISTINCT IDIV(c_custkey; 10) AS user_id FROM customer) WHERE user_id % 10 = 9",
    "ratings": """
      SELECT o_custkey AS userId, l_partkey AS movieId, CAST(0.5 AS DOUBLE) + floor(CAST(l_quantity AS DOUBLE) / CAST(5.56 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS rating, EPOCH(l_shipdate) AS timestamp
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "links": "SELECT p_partkey AS movieId, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_partkey END AS tmdbId FROM part WHERE p_partkey % 4 != 3",
    "vectors": "SELECT vec_id AS tmdb_id, 'movie' AS media_type, embedding FROM embeddings WHERE vec_id % 4 != 3",
}
BASE = ("part", "orders", "lineitem", "customer", "embeddings")


def _spell(sql: str, spark: bool) -> str:
    sql = re.sub(r"\bIDIV\(((?:[^();]|\([^()]*\))*); (\d+)\)", r"(\1 div \2)" if spark else r"(\1 // \2)", sql)
    sql = re.sub(r"\bDAY\(('[^']*'); ((?:[^();]|\([^()]*\))*)\)", r"date_add(date \1, cast(\2 as int))" if spark else r"(date \1 + cast(\2 as integer))", sql)
    sql = re.sub(r"\bEPOCH\((\w+)\)", r"unix_timestamp(\1)" if spark else r"cast(epoch(\1) as bigint)", sql)
    sql = re.sub(r"\bEACH\((\d+); i; ((?:[^();]|\((?:[^()]|\([^()]*\))*\))*)\)", r"transform(sequence(1, \1), i -> \2)" if spark else r"list_transform(range(1, \1 + 1), lambda i: \2)", sql)
    sql = re.sub(r"\bLIST\(", "array(" if spark else "list_value(", sql)
    return sql if spark else sql.replace(" AS STRING)", " AS VARCHAR)").replace(" AS cast,", ' AS "cast",')


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame. `similar_ids` is named `similar`."""
    sql = _spell(VIEWS[name], True)
    if "figures" in sql:
        sql = sql.replace("FROM figures", f"FROM ({_spell(VIEWS['figures'], True)}) figures")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    out = spark.sql(sql, **used)
    return out.withColumnRenamed("similar_ids", "similar") if name == "items" else out


@lru_cache
def prelude() -> str:
    """The views as common table expressions for the oracle."""
    parts = []
    for name, sql in VIEWS.items():
        parts.append(f"{name} AS ({_spell(sql, False)})")
    return ",\n".join(parts)
