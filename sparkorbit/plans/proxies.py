"""The driver tables in the roles of jets, tracks, scores, graph points and modes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jets: flavour 5, 0 or 4 by status, momentum from the price, events are customers."""
    o = table(spark, sf_dir, "orders")
    flavour = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 0).otherwise(4)
    return o.select(F.col("o_orderkey").alias("source_row"), F.col("o_custkey").alias("event_number"), flavour.alias("label_raw"), F.col("o_totalprice").alias("pt"), ((F.col("o_orderkey") * 37 % 601 - 300) / 100).alias("eta"))


JETS = """jets AS (SELECT o_orderkey AS source_row, o_custkey AS event_number,
  CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 0 ELSE 4 END AS label_raw,
  o_totalprice AS pt, (o_orderkey * 37 % 601 - 300) / 100 AS eta FROM orders)"""


def two_flavours(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jets(spark, sf_dir).where(F.col("label_raw").isin(0, 5))
    return j.withColumn("y", (F.col("label_raw") == 5).cast("int"))


BL = JETS + """, bl AS (SELECT *, CASE WHEN label_raw = 5 THEN 1 ELSE 0 END AS y FROM jets WHERE label_raw IN (0, 5))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (method, source_row, event_number, y, score, ...) of two methods with many ties."""
    b = two_flavours(spark, sf_dir)
    made = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.expr(f"((source_row * {p} + event_number * {q}) % 1000 * {w} + {1000 * (10 - w)} * y) div 10 / 1000").alias("score")) for m, p, q, w in METHODS)))
    return b.select("*", made.alias("s")).select(*b.columns, "s.method", "s.score")


METHODS = (("a", 7919, 10477, 7), ("b", 5231, 3571, 8))
SCORES = BL + ", scores AS (" + " UNION ALL ".join(f"SELECT *, '{m}' AS method, ((source_row * {p} + event_number * {q}) % 1000 * {w} + {1000 * (10 - w)} * y) // 10 / 1000 AS score FROM bl" for m, p, q, w in METHODS) + ")"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tracks of an order: slot from 1, coordinates u, v, significances s, z, a hit count."""
    li = table(spark, sf_dir, "lineitem")
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*SLOT))
    return li.select(F.col("l_orderkey").alias("jet"), slot.alias("slot"), (F.col("l_extendedprice") / 10000 - 3).alias("s"), (F.col("l_quantity") / 10 - 2.5).alias("z"), (F.col("l_discount") * 10 - 0.5).alias("u"), (F.col("l_tax") * 10 - 0.4).alias("v"), F.col("l_linenumber").alias("hits"))


TRACKS = f"""tracks AS (SELECT l_orderkey AS jet, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(SLOT)}) AS slot,
  l_extendedprice / 10000 - 3 AS s, l_quantity / 10 - 2.5::DOUBLE AS z, l_discount * 10 - 0.5::DOUBLE AS u, l_tax * 10 - 0.4::DOUBLE AS v, l_linenumber AS hits FROM lineitem)"""


_SUSY = ("lep1_pt lep1_eta lep1_phi lep2_pt lep2_eta lep2_phi missing_energy missing_phi MET_rel axial_MET M_R M_TR_2 R MT2 S_R M_Delta_R dPhi_r_b cos_theta_r1").split()


def _wave(k: int) -> str:
    """A column of whole numbers spread by k, as SQL of both engines."""
    return f"((l_orderkey * {2 * k + 3} + l_partkey * {k + 7} + l_linenumber) % {97 + k}) / 10.0"


def _column(c: str, k: int, gone: dict[str, str]) -> Column:
    """The same column in Spark, -999 where it is missing: divided as a double, which gives the value of the decimal without its cost."""
    wave = f"({_wave(k).removesuffix(' / 10.0')} / 10D)"
    return F.expr(f"CASE WHEN {gone[c]} THEN -999D ELSE {wave} END" if c in gone else wave).alias(c)


def susy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of the SUSY table, M_R missing now and then; ids are places in an order of all columns."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *(_column(c, k, {"M_R": "l_orderkey % 5 = 0"}) for k, c in enumerate(_SUSY)))


SUSY = "susy AS (SELECT l_orderkey * 10 + l_linenumber AS id, " + ", ".join((f"CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE {_wave(k)} END" if c == "M_R" else _wave(k)) + f"::DOUBLE AS {c}" for k, c in enumerate(_SUSY)) + " FROM lineitem)"

_HIGGS = [*(f"PRI_{o}_{q}" for o in ("tau", "lep", "jet_leading", "jet_subleading") for q in ("pt", "eta", "phi")), "PRI_met", "PRI_met_phi", "DER_mass", "PRI_jet_num"]
_HIGGS_GONE = {"DER_mass": "l_orderkey % 4 = 0", "PRI_jet_leading_phi": "l_orderkey % 7 = 0"}


def higgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of the Higgs table, two columns missing now and then."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *(_column(c, k, _HIGGS_GONE) for k, c in enumerate(_HIGGS)))


HIGGS = "higgs AS (SELECT l_orderkey * 10 + l_linenumber AS id, " + ", ".join((f"CASE WHEN {_HIGGS_GONE[c]} THEN NULL ELSE {_wave(k)} END" if c in _HIGGS_GONE else _wave(k)) + f"::DOUBLE AS {c}" for k, c in enumerate(_HIGGS)) + " FROM lineitem)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as graph points (vec_id, embedding, y)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") >= 5).cast("int").alias("y"))


POINTS = """points AS (SELECT vec_id, embedding::DOUBLE[] AS embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings)"""

#: A self-tuning graph (k = 8, scale from the 4th neighbour) with its posterior and potential.
GRAPH = POINTS + """, pair AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding, b.embedding) ** 2 AS d2
  FROM points a JOIN points b ON a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 12), dst) AS rank FROM pair) WHERE rank <= 8),
raw_scale AS (SELECT src AS id, sqrt(d2) AS sigma FROM knn WHERE rank = 4),
scale AS (SELECT id, CASE WHEN sigma > 0 THEN sigma ELSE (SELECT median(sigma) FROM raw_scale WHERE sigma > 0) END AS sigma FROM raw_scale),
dir AS (SELECT k.src, k.dst, exp(-k.d2 / greatest(a.sigma * b.sigma, 1e-12)) AS w FROM knn k JOIN scale a ON a.id = k.src JOIN scale b ON b.id = k.dst),
edges AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM dir UNION ALL SELECT dst, src, w FROM dir) GROUP BY 1, 2),
prior AS (SELECT avg(y) AS p1 FROM points),
vote AS (SELECT e.src AS id, sum(e.w) AS degree, sum(e.w * p.y) AS v1 FROM edges e JOIN points p ON p.vec_id = e.dst GROUP BY 1),
post AS (SELECT id, degree, (v1 + q.p1) / (degree + 1) AS p1, q.p1 AS prior1 FROM vote, prior q),
pot AS (SELECT *, p1 * ln(p1 / prior1) + (1 - p1) * ln((1 - p1) / (1 - prior1)) AS j,
  greatest(-ln(least(prior1, 1 - prior1)) - (p1 * ln(p1 / prior1) + (1 - p1) * ln((1 - p1) / (1 - prior1))), 0) AS v FROM post)"""
LAPLACIAN = GRAPH + """, lap AS (SELECT src, dst, sum(value) AS value FROM (
  SELECT e.src, e.dst, -e.w / sqrt(a.degree * b.degree) AS value FROM edges e JOIN post a ON a.id = e.src JOIN post b ON b.id = e.dst
  UNION ALL SELECT id, id, 1.0 FROM post) GROUP BY 1, 2)"""

MODES = 6


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form modes (id, k, phi) on the points."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(MODES))).alias("k"))
    return e.withColumn("phi", F.cos(F.lit(0.1) * F.col("k") * F.col("id")))


def eigen(spark: SparkSession) -> DataFrame:
    """Their eigenvalues: modes 2 and 3 are degenerate."""
    return spark.createDataFrame([(k, 0.2 if k == 3 else k / 10) for k in range(1, MODES + 1)], "k int, epsilon double")


def measurement(spark: SparkSession) -> DataFrame:
    """A positive matrix (i, j, m)."""
    return spark.createDataFrame([(i, j, 1.0 / (2 + i + j) + (0.2 if i == j else 0.0)) for i in range(1, MODES + 1) for j in range(1, MODES + 1)], "i int, j int, m double")


CLOSED = f"""modes AS (SELECT vec_id AS id, k, cos(0.1::DOUBLE * k * vec_id) AS phi FROM embeddings, range(1, {MODES + 1}) t(k)),
eigen AS (SELECT k, CASE WHEN k = 3 THEN 0.2::DOUBLE ELSE k / 10 END AS epsilon FROM range(1, {MODES + 1}) t(k)),
meas AS (SELECT i, j, 1 / (2 + i + j) + CASE WHEN i = j THEN 0.2::DOUBLE ELSE 0 END AS m FROM range(1, {MODES + 1}) a(i), range(1, {MODES + 1}) b(j)),
state AS (SELECT id, k, phi / sqrt(sum(phi * phi) OVER (PARTITION BY id) + 1e-12) AS a FROM modes)"""


def splitmix(source: str, key: str, seed: int, name: str) -> str:
    """CTEs that give ``name``: the rows of ``source`` with h, the unsigned SplitMix64 of key + seed."""
    m, s = "18446744073709551616::UHUGEINT", f"{(seed + 0x9E3779B97F4A7C15) % (1 << 64)}::UHUGEINT"

    # 64-bit product by halves: (high * c mod 2^32) * 2^32 + low * c
    def times(z: str, c: int) -> str:
        lo, hi = f"({z} & 4294967295)::UHUGEINT", f"({z} >> 32)::UHUGEINT"
        return f"((({hi} * {c & 0xFFFFFFFF}::UHUGEINT % 4294967296) * 4294967296 + ({lo} * {c >> 32}::UHUGEINT % 4294967296) * 4294967296 + {lo} * {c & 0xFFFFFFFF}::UHUGEINT) % {m})::UBIGINT"

    return (
        f"{name}_1 AS (SELECT *, (({key})::UHUGEINT + {s}) % {m} AS z0 FROM {source}), "
        f"{name}_2 AS (SELECT *, xor(z0::UBIGINT, z0::UBIGINT >> 30) AS z1 FROM {name}_1), "
        f"{name}_3 AS (SELECT *, {times('z1', 0xBF58476D1CE4E5B9)} AS z2 FROM {name}_2), "
        f"{name}_4 AS (SELECT *, xor(z2, z2 >> 27) AS z3 FROM {name}_3), "
        f"{name}_5 AS (SELECT *, {times('z3', 0x94D049BB133111EB)} AS z4 FROM {name}_4), "
        f"{name} AS (SELECT *, xor(z4, z4 >> 31) AS h FROM {name}_5)"
    )
