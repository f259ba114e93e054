"""Queries job1_frozen_roles and job2_feature_screen: each runs its job twice into one new folder, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import feature_screen, frozen_roles
from sparkorbit.functions.stored import shared_dir
from sparkorbit.plans.proxies import splitmix


def config(job: str) -> dict:
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/sparkorbit-jobs/{job}-{uuid.uuid4().hex}"


def job1_frozen_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "frozen_roles")
    for _ in range(2):  # a glob, as the table may be one file
        frozen_roles.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/output", f"{out}/checkpoint", **config("frozen_roles"))
    return frozen_roles.read_ledger(spark, f"{out}/output").drop("batch")


def job2_feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "feature_screen")
    for _ in range(2):
        feature_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, **config("feature_screen"))
    return feature_screen.read_screen(spark, out)


def _roles_sql(seed: int, stop_share: float, **_: object) -> str:
    plain = r"trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
    return f"""WITH d AS (SELECT doc_id, source, lang, n_chars, {plain} AS plain FROM documents),
e AS (SELECT * EXCLUDE plain, CASE WHEN plain <> '' THEN ('0x' || sha256(plain)[:15])::BIGINT END AS event FROM d),
{splitmix("e", "event", seed, "m")}
SELECT doc_id, source, lang, n_chars, event, (h & 1)::INT AS half, h % 10000 < {round(stop_share * 10_000)} AS stop,
  CASE WHEN event IS NULL THEN 'outside' WHEN event % 10 <= 5 THEN 'base' WHEN event % 10 <= 7 THEN 'operator' WHEN event % 10 = 8 THEN 'dimension' ELSE 'test' END AS role FROM m"""


def _screen_sql(label: str, size_edges: list[int], **_: object) -> str:
    share = lambda p: f"coalesce(len(regexp_extract_all(t, '{p}')) / nullif(length(t), 0), 0)"
    scores = {
        "characters": "length(t)::DOUBLE", "words": "n::DOUBLE", "word_length": "coalesce(length(t) / nullif(n, 0), 0)", "lines": "len(lines)::DOUBLE", "distinct_lines": "len(list_distinct(lines)) / len(lines)",
        "letters": share("[A-Za-z]"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "stops": share("[.!?]"),
    }
    cases = " ".join(f"WHEN length(t) < {b} THEN '{a}-{b - 1}'" for a, b in zip([0, *size_edges], size_edges, strict=False))
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n, string_split(t, chr(10)) AS lines FROM d),
f AS (SELECT {label}::INT AS y, coalesce(lang, '-') AS lang, CASE {cases} ELSE '{size_edges[-1]}+' END AS size, {", ".join(f"{v} AS {k}" for k, v in scores.items())} FROM c JOIN labels USING (doc_id) WHERE {label} IN (0, 1)),
u AS ({" UNION ALL ".join(f"SELECT y, lang, size, '{k}' AS feature, {k} AS score FROM f" for k in scores)}),
s AS (SELECT y, 'all' AS axis, 'all' AS slice, feature, score FROM u UNION ALL SELECT y, 'lang', lang, feature, score FROM u UNION ALL SELECT y, 'size', size, feature, score FROM u),
g AS (SELECT axis, slice, feature, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY axis, slice, feature ORDER BY score DESC)),
a AS (SELECT axis, slice, feature, sum(pos) AS n_pos, sum(neg) AS n_neg, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS ap FROM r GROUP BY ALL),
b AS (SELECT axis, slice, feature FROM (SELECT *, row_number() OVER (PARTITION BY axis, slice ORDER BY abs(round(auc - 0.5, 9)) DESC, feature) AS k FROM a WHERE auc IS NOT NULL) WHERE k = 1)
SELECT a.axis, a.slice, a.feature, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 9) AS auc, round(ap, 9) AS average_precision, b.feature IS NOT NULL AS strongest
FROM a LEFT JOIN b ON b.axis = a.axis AND b.slice = a.slice AND b.feature = a.feature"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_frozen_roles": job1_frozen_roles, "job2_feature_screen": job2_feature_screen}
ORACLE: dict[str, str] = {"job1_frozen_roles": _roles_sql(**config("frozen_roles")), "job2_feature_screen": _screen_sql(**config("feature_screen"))}
