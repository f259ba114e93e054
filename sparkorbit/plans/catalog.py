"""Every operator as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.intervals import paired_binomial
from ..functions.stored import stored
from ..operators import align, bootstrap, dimension, evaluate, features, gated_encoder, graph, metric_join, readout, roles, selection, spectrum
from ..operators import tracks as tk
from ..sources import artifacts, tables
from ..sources import jets as scan
from . import proxies as px

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# -- filters, samples, roles --------------------------------------------------


@query
def fiducial_filter(spark, sf):
    j = px.jets(spark, sf)
    return j.where(roles.fiducial(F.col("pt") / 1000, F.col("eta"), F.col("label_raw"))).select("source_row", "event_number", "label_raw", "pt", "eta")


def _odd_jets(spark, sf):
    """Jets of which some have a null, an infinite or a NaN coordinate."""
    row = F.col("source_row")
    pt = F.when(row % 13 == 0, F.lit(None)).when(row % 17 == 0, F.lit(float("inf"))).otherwise(F.col("pt"))
    eta = F.when(row % 19 == 0, F.lit(float("nan"))).otherwise(F.col("eta"))
    return px.jets(spark, sf).withColumns({"pt": pt, "eta": eta})


@query
def fiducial_audit(spark, sf):
    return roles.fiducial_audit(_odd_jets(spark, sf), F.col("pt") / 1000, F.col("eta"), F.col("label_raw"))


@query
def fiducial_pilot(spark, sf):
    j = _odd_jets(spark, sf)
    return j.where(roles.fiducial(F.col("pt") / 1000, F.col("eta"), F.col("label_raw"), pilot=True)).select("source_row", "label_raw")


@query
def event_cap(spark, sf):
    return roles.event_cap(px.jets(spark, sf), "event_number", 300).select("source_row", "event_number")


@query
def label_encoding(spark, sf):
    text = F.when(F.col("label_raw") == 5, " S ").when(F.col("source_row") % 2 == 0, "Background").when(F.col("source_row") % 3 == 0, "0.0").otherwise("b")
    return tables.encode_labels(px.jets(spark, sf).withColumn("label", text), "label").groupBy("label", "y").agg(F.count("*").alias("n"))


@query
def label_encoding_by_order(spark, sf):
    o = px.table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return tables.encode_labels(o, "o_orderstatus").groupBy("o_orderstatus", "y").agg(F.count("*").alias("n"))


@query
def sentinel_clean(spark, sf):
    e = px.table(spark, sf, "events")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(-999.0)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    clean = sc.clean_sentinel(v)
    return e.select("event_type", clean.alias("c")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("c").alias("n_clean"), r6(F.sum("c"), "total"))


@query
def mod10_roles(spark, sf):
    return px.jets(spark, sf).select("source_row", roles.mod10_role(F.col("event_number")).alias("role"))


def _with_roles(spark, sf):
    return px.two_flavours(spark, sf).withColumn("role", roles.mod10_role(F.col("event_number")))


@query
def role_audit(spark, sf):
    return roles.role_audit(_with_roles(spark, sf))


@query
def role_overlap(spark, sf):
    df = _with_roles(spark, sf).withColumn("role", F.when(F.col("source_row") % 50 == 0, "extra").otherwise(F.col("role")))
    return roles.role_overlaps(df)


@query
def partition_check(spark, sf):
    j = px.jets(spark, sf).select("source_row")
    rows = j.where("source_row % 97 <> 0").union(j.where("source_row % 31 = 0"))
    return roles.partition_violations(rows, "source_row", j.count())


@query
def splitmix_split(spark, sf):
    e = F.col("event_number")
    j = px.jets(spark, sf).select("event_number").distinct()
    return j.select("event_number", roles.split_bit(e, 17).alias("half"), roles.split_fraction(e, 0.3, 5).cast("int").alias("inner"))


@query
def balanced_sample(spark, sf):
    return roles.balanced_sample(px.two_flavours(spark, sf), 0, "source_row", seed=3).select("source_row", "y")


def _urgent(spark, sf):
    """Orders by whether they are urgent: a rarer class."""
    o = px.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("source_row"), F.col("o_custkey").alias("event_number"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


@query
def stratified_take(spark, sf):
    return roles.stratified_take(_urgent(spark, sf), 8000, "source_row", seed=9).select("source_row", "y")


@query
def stratified_limit(spark, sf):
    return roles.proportional_sample(_urgent(spark, sf), 700, "source_row", seed=11).select("source_row", "y")


@query
def random_split(spark, sf):
    return roles.random_split(_urgent(spark, sf), 0.25, "source_row", seed=12).select("source_row", "role")


@query
def fixed_roles(spark, sf):
    return roles.fixed_roles(_urgent(spark, sf), {"base": 600, "operator": 200, "audit": 101}, "source_row", seed=13).select("source_row", "y", "role")


def _grouped(spark, sf):
    """Jets in groups of one label: those of an event and flavour."""
    return px.two_flavours(spark, sf).withColumn("grp", F.col("event_number") * 2 + F.col("y"))


@query
def group_limit(spark, sf):
    return roles.group_limit(_grouped(spark, sf), 500, "grp", seed=14).select("source_row", "grp")


@query
def group_holdout(spark, sf):
    return rounded(roles.group_holdout(_grouped(spark, sf), "grp", "y", 0.2, 4), "size_error", "balance_error")


@query
def tail_split(spark, sf):
    j = px.two_flavours(spark, sf)
    n = px.jets(spark, sf).count()
    return j.groupBy(roles.tail_split(F.col("source_row"), n, n // 5).alias("role")).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))


@query
def event_halves(spark, sf):
    return roles.event_halves(px.jets(spark, sf), "event_number", 21).groupBy("event_number", "half").agg(F.count("*").alias("n"))


@query
def missing_classes(spark, sf):
    j = _with_roles(spark, sf).where("role <> 'test' or y = 1")
    return roles.missing_classes(j)


@query
def split_violations(spark, sf):
    row = F.col("source_row")
    j = _with_roles(spark, sf).withColumn("role", F.when(row % 211 == 0, "test").otherwise(F.col("role")))
    j = j.withColumn("part", F.when(row % 3 == 0, "encoder").when(row % 5 == 0, "early_stop"))
    j = j.where("source_row % 97 <> 0").union(j.where("source_row % 31 = 0"))
    residues = {"base": {0, 1, 2, 3, 4, 5}, "operator": {6, 7}, "dimension": {8}, "test": {9}}
    return roles.split_violations(j, px.jets(spark, sf).count(), residues, {"encoder": "base", "early_stop": "base"}, part="part")


@query
def jet_index(spark, sf):
    return scan.jet_index(_odd_jets(spark, sf), seed=3)[0]


@query
def labels_and_events(spark, sf):
    j = px.jets(spark, sf)
    return scan.labels_and_events(j, scan.jet_index(j, seed=3)[0])


@query
def anti_landmarks(spark, sf):
    j = px.jets(spark, sf)
    marks = j.where("source_row % 3 = 0").select("source_row")
    rest = j.join(marks, "source_row", "left_anti").groupBy("label_raw").agg(F.count("*").alias("n_rest"))
    same = j.join(marks, "source_row", "left_semi").groupBy("label_raw").agg(F.count("*").alias("n_marks"))
    return rest.join(same, "label_raw")


@query
def set_operations(spark, sf):
    j = px.jets(spark, sf).select("event_number")
    a, b = j.where("event_number % 2 = 0"), j.where("event_number % 3 = 0")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(a.union(b), "stacked").crossJoin(n(a.intersect(b), "shared")).crossJoin(n(a.distinct().subtract(b), "only_a")).crossJoin(n(j.distinct(), "events"))


# -- groups -------------------------------------------------------------------


@query
def group_hash(spark, sf):
    d = px.table(spark, sf, "documents").withColumn("g", F.xxhash64("text"))
    return d.groupBy("g").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


@query
def group_audit(spark, sf):
    return roles.group_audit(px.table(spark, sf, "documents").withColumn("g", F.xxhash64("text")), "g")


@query
def group_conflicts(spark, sf):
    d = px.table(spark, sf, "documents").join(px.table(spark, sf, "labels"), "doc_id").withColumn("g", F.sha2("text", 256))
    return roles.group_conflicts(d, "g", "toxic").select("g", "n_labels", "n_rows")


# -- joins --------------------------------------------------------------------


@query
def align_predictions(spark, sf):
    s = px.scores(spark, sf)
    expected = px.two_flavours(spark, sf).select(*align.KEYS)
    a, b = (s.where(F.col("method") == m).select(*align.KEYS, "score") for m in "ab")
    return align.align_predictions(align.align_predictions(expected, a, "score", "score_a"), b, "score", "score_b")


@query
def alignment_faults(spark, sf):
    expected = px.two_flavours(spark, sf).select(*align.KEYS)
    frame = px.scores(spark, sf).where("method = 'a' and source_row % 13 <> 0").withColumn("score", F.when(F.col("source_row") % 17 == 0, 1.5).otherwise(F.col("score")))
    frame = frame.union(frame.where("source_row % 19 = 0"))
    return align.alignment_faults(expected, frame)


@query
def paired_mistag(spark, sf):
    df = align_predictions(spark, sf)
    counts = align.paired_counts(df, "score_a", "score_b", 0.6, 0.6)
    p = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: paired_binomial(int(x), int(y))).astype(float), "double")
    return counts.withColumn("p_value", r6(p("only_a", "only_b")))


@query
def same_label_check(spark, sf):
    a = px.two_flavours(spark, sf)
    b = a.withColumn("y", F.when(F.col("source_row") % 101 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return align.same_label_violations(a, b)


# -- tracks -------------------------------------------------------------------

_FIELDS = ["s", "z", "u", "v", "hits"]


def _nested(spark, sf):
    return tk.nest(px.tracks(spark, sf), "jet", ["slot"], ["slot", *_FIELDS])


@query
def track_topk(spark, sf):
    top = _nested(spark, sf).select("jet", F.posexplode(tk.top_k(F.col("tracks"), "s", 3)).alias("place", "t"))
    return top.select("jet", (F.col("place") + 1).alias("place"), F.col("t.slot").alias("slot"), r6(F.col("t.s"), "s"))


@query
def track_transform(spark, sf):
    t = px.tracks(spark, sf)
    q = tk.transform_field("qOverP", F.col("u") / 100)
    d, w = tk.transform_field("d0", F.col("s")), tk.transform_field("phiUncertainty", F.col("v"))
    return t.select("jet", "slot", r6(q, "q"), r6(d, "d"), r6(w, "w"))


def _odd_tracks(spark, sf):
    """Tracks of which some have a value that is not finite."""
    t, k = px.tracks(spark, sf), F.col("jet") + F.col("slot")
    s_ = F.when(k % 5 == 0, F.lit(float("inf"))).when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None)).otherwise(F.col("s"))
    return t.withColumn("s", s_)


@query
def track_summary(spark, sf):
    j = px.jets(spark, sf).select(F.col("source_row").alias("jet"))
    out = tk.summaries(j, _odd_tracks(spark, sf), "jet", ["s", "z"])
    return rounded(out, *out.columns[1:], digits=9)  # quantiles have up to eight decimals: no ties


@query
def jet_summaries(spark, sf):
    index = scan.jet_index(px.jets(spark, sf), seed=3)[0]
    out = scan.jet_summaries(px.jets(spark, sf), index, px.tracks(spark, sf), ["z"])
    return rounded(out.select("source_row", "role", "z_mean", "z_q50"), "z_mean", "z_q50", digits=9)


def _nested_jets(spark, sf):
    j = px.jets(spark, sf)
    return j.join(_nested(spark, sf).withColumnRenamed("jet", "source_row"), "source_row", "left")


@query
def jet_batches(spark, sf):
    j = _nested_jets(spark, sf)
    out = scan.jet_batches(j, scan.jet_index(j, seed=3)[0], ["s", "z"], "s", 2)
    out = out.select("source_row", F.col("context")[3].alias("n_tracks"), F.posexplode("x").alias("place", "t"))
    return out.select("source_row", "n_tracks", "place", r6(F.col("t")[0], "s"), r6(F.col("t")[1], "z"))


_PARTS = {"d0": "s", "z0": "z", "deta": "u", "dphi": "v", "q_over_p": "z", "pixel": "hits", "sct": "slot", "shared": ["hits", "slot"], "split": ["hits"]}


@query
def jet_features(spark, sf):
    j = _nested_jets(spark, sf)
    j = j.withColumn("tracks", F.coalesce("tracks", F.array().cast(j.schema["tracks"].dataType)))
    cols = tk.jet_features(F.col("tracks"), _PARTS, F.log1p(F.col("pt") / 1000), F.col("eta"), F.size("tracks"))
    return rounded(j.select("source_row", *(c.alias(n) for n, c in cols.items())), *cols, digits=9)


def _inputs(spark, sf, kind, fields):
    out = tk.node_inputs(px.tracks(spark, sf), "jet", "slot", fields, kind, ["s", "z", "u", "v"], 2, 1.5)
    return out.select("jet", "slot", F.posexplode("x").alias("place", "value")).withColumn("value", r6("value"))


@query
def node_inputs_set(spark, sf):
    return _inputs(spark, sf, "set", ["s", "z"])


@query
def node_inputs_graph(spark, sf):
    return _inputs(spark, sf, "graph", ["s", "z"])


@query
def node_inputs_sequential(spark, sf):
    return _inputs(spark, sf, "sequential", ["s"])


@query
def node_inputs_parallel(spark, sf):
    return _inputs(spark, sf, "parallel", ["s", "z"])


@query
def node_inputs_hybrid(spark, sf):
    return _inputs(spark, sf, "hybrid", ["s"])


def _encoder_rows(spark, sf):
    """Jets of two flavours with the hybrid inputs of their tracks: key, event, y, nodes, context."""
    x = tk.node_inputs(px.tracks(spark, sf), "jet", "slot", ["s", "z"], "hybrid", ["s", "z", "u", "v"], 2, 1.5)
    nodes = x.groupBy("jet").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("t"))
    j = px.two_flavours(spark, sf).join(nodes, F.col("jet") == F.col("source_row"), "left")
    return stored(j.select(F.col("source_row").alias("key"), F.col("event_number").alias("event"), "y", F.col("t.x").alias("nodes"), F.array(F.col("pt") / 1e5, F.col("eta")).alias("context")))


@query
def architecture_search(spark, sf):
    arms = [{"hidden": h, "depth": d, "heads": m} for h, d, m in ((4, 1, 1), (8, 1, 1), (8, 2, 1), (8, 1, 2), (12, 2, 2), (8, 3, 4))]
    shape = gated_encoder.Shape(fields=2, branches=5, context=2, geometry=6)
    return gated_encoder.search(_encoder_rows(spark, sf), shape, arms, rungs=(4, 8, 16))


@query
def gated_branches(spark, sf):
    model = gated_encoder.GatedEncoder(gated_encoder.Shape(fields=2, branches=5, context=2, hidden=6, geometry=4), steps=12, refit_steps=4).fit(_encoder_rows(spark, sf))
    return rounded(spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(model.soft, model.gates, strict=True))], "branch int, gate double, open boolean"), "gate")


@query
def dropout_shift(spark, sf):
    """The change of a jet's mean significance, squashed, when tracks are dropped."""
    n = _nested(spark, sf)
    score = lambda t: sc.sigmoid(F.aggregate(t, F.lit(0.0), lambda a, x: a + x["s"]) / F.size(t))
    kept = tk.dropout(F.col("tracks"), F.col("jet"), 0.7, 5)
    both = n.select(score(F.col("tracks")).alias("before"), score(kept).alias("after"))
    return rounded(evaluate.score_shift(both), "p95_shift", "mean_shift")


@query
def jet_context(spark, sf):
    j = px.jets(spark, sf).join(px.tracks(spark, sf).groupBy(F.col("jet").alias("source_row")).agg(F.count("*").alias("n")), "source_row", "left")
    cols = tk.context(F.col("pt"), F.col("eta"), F.coalesce(F.col("n"), F.lit(0)))
    return j.select("source_row", *(r6(c, n) for n, c in cols.items()))


@query
def jet_observables(spark, sf):
    j = px.jets(spark, sf).select(F.col("source_row").alias("jet")).join(_nested(spark, sf), "jet", "left")
    kind = _nested(spark, sf).schema["tracks"].dataType
    t = F.coalesce("tracks", F.array().cast(kind))
    j = j.select("jet", t.alias("tracks"))
    cols = tk.observables(F.col("tracks"), "s", "u", "v", "hits")
    return rounded(j.select("jet", *(c.alias(n) for n, c in cols.items())), *cols, digits=9)


def _pairs(spark, sf):
    return tk.relations(px.tracks(spark, sf), "jet", "slot", ["s", "z", "u", "v"])


@query
def track_relation(spark, sf):
    return rounded(_pairs(spark, sf), "d2")


@query
def local_adjacency(spark, sf):
    return rounded(tk.local_adjacency(_pairs(spark, sf), "jet", 2), "w")


@query
def parallel_adjacency(spark, sf):
    return rounded(tk.parallel_adjacency(_pairs(spark, sf), "jet", 1.5), "w")


@query
def sequential_messages(spark, sf):
    return rounded(tk.parallel_messages(px.tracks(spark, sf), "jet", "slot", ["s", "z", "u", "v"], "s", 1.5, 2), "s")


@query
def physical_coordinates(spark, sf):
    t = F.col("tracks")
    most = lambda f: F.array_max(F.transform(t, lambda x: F.abs(x[f])))
    return _nested(spark, sf).select("jet", r6(most("s"), "max_s"), r6(most("z"), "max_z"), F.size(t).alias("n_tracks"))


@query
def track_dropout(spark, sf):
    kept = tk.dropout(F.col("tracks"), F.col("jet"), 0.7, 5)
    return _nested(spark, sf).select("jet", F.explode(kept).alias("t")).select("jet", "t.slot")


# -- scalars and feature maps -------------------------------------------------


@query
def discriminants(spark, sf):
    p = px.table(spark, sf, "lineitem").select(F.col("l_discount").alias("pb"), F.col("l_tax").alias("pu"), (F.col("l_quantity") / 100).alias("pc"), F.lit(0.01).alias("ptau")).distinct()
    c = {k: F.col(k) for k in ("pc", "ptau", "pu")}
    return p.select("pb", "pu", "pc", r6(sc.binary_score(F.col("pb"), F.col("pu")), "binary"), r6(sc.discriminant(F.col("pb"), c, sc.GN2_FRACTIONS), "gn2"), r6(sc.discriminant(F.col("pb"), c, sc.DL1_FRACTIONS), "dl1"))


@query
def pair_kinematics(spark, sf):
    j = px.jets(spark, sf)
    pt, phi = F.col("pt") / 1000, F.col("eta") * 1.3
    cols = sc.pair_kinematics(pt, F.col("eta"), phi, pt * 0.7 + 5, -F.col("eta") / 2, phi * 2 + 1)
    cols |= {f"met_{k}": v for k, v in sc.met_pair(pt, phi, pt / 2 + 3, -phi).items()}
    return j.select("source_row", *(r6(c, n) for n, c in cols.items()), sc.topology(F.col("source_row") % 4).alias("topology"))


@query
def periodic_angles(spark, sf):
    j = px.jets(spark, sf).select("source_row", (F.col("eta") * 3).alias("phi"), F.col("eta").alias("ref"))
    out = features.periodic(j, "phi", "ref")
    return out.select("source_row", r6("phi_sin"), r6("phi_cos"), r6(sc.wrap_angle(F.col("ref") * 5), "wrapped")).toDF("source_row", "phi_sin", "phi_cos", "wrapped")


@query
def finite_ratio(spark, sf):
    p = px.table(spark, sf, "part")
    return p.select("p_partkey", r6(sc.finite_ratio(F.col("p_retailprice"), F.col("p_size") - 10), "ratio"))


@query
def robust_scale(spark, sf):
    t = px.tracks(spark, sf)
    out = features.RobustMap(["s", "z"]).fit(t).transform(t)
    return out.select("jet", "slot", r6("s"), r6("z")).toDF("jet", "slot", "s", "z")


@query
def standard_scale(spark, sf):
    j = px.jets(spark, sf).select("source_row", F.when(F.col("source_row") % 9 == 0, None).otherwise(F.col("pt")).alias("pt"), "eta", F.lit(2.0).alias("flat"))
    out = features.StandardMap(["pt", "eta", "flat"]).fit(j).transform(j)
    return out.select("source_row", r6("pt"), r6("eta")).toDF("source_row", "pt", "eta")


@query
def median_impute_flags(spark, sf):
    j = px.jets(spark, sf).select("source_row", F.when(F.col("source_row") % 9 == 0, -999.0).otherwise(F.col("pt")).alias("pt"), F.col("eta").cast("double").alias("eta"))
    out = features.ImputeMap(["pt", "eta"]).fit(j).transform(j)
    return out.select("source_row", r6("pt"), r6("eta"), "pt_missing").toDF("source_row", "pt", "eta", "pt_missing")


@query
def log_if_positive(spark, sf):
    j = px.jets(spark, sf).select("source_row", "pt", "eta")
    out = features.log_if_positive(j, ["pt", "eta"])[0]
    return out.select("source_row", r6("pt__log1p")).toDF("source_row", "pt__log1p")


@query
def susy_map(spark, sf):
    s = px.susy(spark, sf)
    out = features.SusyMap(keys=("id",)).fit(s).transform(s)
    names = ["lep1_pt", "M_R", "sin_lep1_phi", "cos_dphi_lep1_met", "M_R_missing", "sin_dphi_lep2_met"]
    return rounded(out.select("id", *names), *names)


@query
def higgs_compact_map(spark, sf):
    h = px.higgs(spark, sf)
    out = features.CompactHiggsMap([c for c in h.columns if c != "id"], keys=("id",)).fit(h).transform(h)
    names = ["DER_mass", "PRI_tau_pt", "sin_dphi_PRI_tau_met", "cos_dphi_PRI_jet_leading_met", "missing__DER_mass", "missing__PRI_jet_leading_phi"]
    return rounded(out.select("id", *names), *names)


@query
def higgs_physics_map(spark, sf):
    h = px.higgs(spark, sf)
    out = features.HiggsPhysicsMap([c for c in h.columns if c != "id"], keys=("id",)).fit(h).transform(h)
    names = ["DER_mass", "DER_mass__log1p", "DER_mass_missing", "PRI_tau_phi__sin", "tau_lep__dr"]
    return rounded(out.select("id", *names), *names)


@query
def track_scaler(spark, sf):
    n = tk.nest(_odd_tracks(spark, sf), "jet", ["slot"], ["slot", *_FIELDS])
    out = features.TrackScaler(["s", "z"]).fit(n).transform(n).select("jet", F.explode("tracks").alias("t"))
    return out.select("jet", F.col("t.slot").alias("slot"), r6(F.col("t.s"), "s"), r6(F.col("t.z"), "z"))


@query
def gates(spark, sf):
    j = px.jets(spark, sf).select("source_row", (F.col("eta") * 2).alias("x"))
    x = F.col("x")
    return j.select("source_row", r6(sc.sigmoid(x), "open"), r6(sc.hard_concrete(x, 0.5), "gate"), r6(sc.expected_open(x, 0.5), "expected"))


# -- graph --------------------------------------------------------------------


def _graph(spark, sf):
    p = px.points(spark, sf)
    edges, _ = graph.self_tuning_graph(p)
    edges = stored(edges)
    post = graph.kernel_posterior(edges, p.select(F.col("vec_id").alias("id"), "y"))
    return p, edges, graph.information_potential(post)


@query
def knn_edges(spark, sf):
    p = px.points(spark, sf)
    return rounded(graph.knn(p, p, 8, exclude_self=True), "d2").select("src", "dst", F.col("rank").cast("long").alias("rank"), "d2")


@query
def knn_by_pivots(spark, sf):
    p = px.points(spark, sf)
    out = metric_join.knn_by_pivots(p, p, 8, exclude_self=True)
    return rounded(out, "d2").select("src", "dst", F.col("rank").cast("long").alias("rank"), "d2")


@query
def distributed_modes(spark, sf):
    _, edges, pot = _graph(spark, sf)
    h = stored(graph.graph_operator(graph.laplacian(edges), pot.select("id", "v")))
    eigen, modes = spectrum.distributed_modes(h, 6, graph.degrees(edges))
    unit = modes.select(F.posexplode(F.transform("u", lambda x: x * x)).alias("k", "n")).groupBy((F.col("k") + 1).alias("k")).agg(F.sum("n").alias("n"))
    out = spectrum.residuals(h, eigen, modes).join(unit, "k")
    return out.select(F.col("k").cast("long").alias("k"), (F.col("residual") < 1e-6).alias("converged"), (F.abs(F.col("n") - 1) < 1e-9).alias("unit"))


@query
def self_tuning_graph(spark, sf):
    return rounded(_graph(spark, sf)[1], "w")


@query
def graph_degree(spark, sf):
    return rounded(graph.degree_summary(_graph(spark, sf)[1]), "least", "middle", "most")


@query
def kernel_posterior(spark, sf):
    return rounded(_graph(spark, sf)[2].select("id", "degree", "p1"), "degree", "p1")


@query
def information_potential(spark, sf):
    p, _, pot = _graph(spark, sf)
    out = pot.join(p.select(F.col("vec_id").alias("id"), "y"), "id")
    return out.groupBy("y").agg(F.count("*").alias("n"), r6(F.avg("j"), "avg_j"), r6(F.avg("v"), "avg_v"), r6(F.avg("degree"), "avg_degree"))


@query
def query_affinity_posterior(spark, sf):
    p = px.points(spark, sf)
    marks, asked = p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")
    w = graph.query_affinities(asked, marks)
    post = graph.kernel_posterior(w, marks.select(F.col("vec_id").alias("id"), "y"))
    return rounded(post.select("id", "degree", "p1"), "degree", "p1")


@query
def log_odds_field(spark, sf):
    return _graph(spark, sf)[2].select("id", r6(sc.log_odds_field(F.col("p1"), F.col("prior1")), "field"))


@query
def neighbour_ranks(spark, sf):
    return graph.ranked_neighbours(_graph(spark, sf)[1])


@query
def dense_affinities(spark, sf):
    p = px.points(spark, sf)
    w = graph.dense_affinities(p.where("vec_id % 2 = 1"), p.where("vec_id % 2 = 0"))
    return rounded(graph.affinity_totals(w, 7).drop("q"), "total", "most", "placed")


@query
def laplacian_entries(spark, sf):
    return rounded(graph.laplacian(_graph(spark, sf)[1]), "value")


@query
def operator_entries(spark, sf):
    _, edges, pot = _graph(spark, sf)
    return rounded(graph.graph_operator(graph.laplacian(edges), pot.select("id", "v"), 1.0, 0.5), "value")


@query
def rayleigh_quotient(spark, sf):
    _, edges, pot = _graph(spark, sf)
    h = graph.graph_operator(graph.laplacian(edges), pot.select("id", "v"), 1.0, 0.5)
    return rounded(graph.rayleigh(h, pot.select("id", F.cos(F.col("id") * 0.3).alias("x"))), "rayleigh")


@query
def eigen_residual(spark, sf):
    _, edges, pot = _graph(spark, sf)
    h = stored(graph.graph_operator(graph.laplacian(edges), pot.select("id", "v")))
    eigen, modes = spectrum.solve_modes(h, 12, graph.degrees(edges))
    return rounded(spectrum.residuals(h, eigen, modes).join(eigen, "k"), "residual", "epsilon")


# -- modes in closed form -----------------------------------------------------


def _extended(spark, sf):
    _, edges, pot = _graph(spark, sf)
    return spectrum.extend_modes(edges, px.modes(spark, sf), pot, px.eigen(spark))


@query
def inductive_extension(spark, sf):
    return rounded(_extended(spark, sf), "phi")


@query
def stable_prefix(spark, sf):
    return spectrum.stable_prefix(_extended(spark, sf).withColumn("stable", F.col("stable") & (F.col("k") != 5)))


@query
def extend_stable(spark, sf):
    _, edges, pot = _graph(spark, sf)
    # The potential of one vertex puts a pole at the fourth mode.
    pot = pot.select("id", F.when(F.col("id") == 7, F.lit(0.4) - 1).otherwise(F.col("v")).alias("v"))
    return rounded(spectrum.extend_stable(edges, px.modes(spark, sf), pot, px.eigen(spark), strict=False), "phi")


@query
def occupations(spark, sf):
    s = spectrum.states(px.modes(spark, sf)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "a"))).alias("s"))
    n = spectrum.occupations(F.transform("s", lambda x: x["a"]))
    return s.select("id", F.posexplode(n).alias("place", "n")).withColumn("n", r6("n"))


@query
def orbital_state(spark, sf):
    return rounded(spectrum.states(px.modes(spark, sf), [1, 3, 4]), "a")


@query
def spectral_blocks(spark, sf):
    c = px.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), -2).alias("epsilon"))
    order = Window.orderBy("epsilon", "c_nationkey")  # a row for each nation
    return dimension.spectral_blocks(c.select(F.row_number().over(order).cast("long").alias("k"), "epsilon"))


def _shares(spark, sf):
    return dimension.field_projection(px.modes(spark, sf), _field(spark, sf), px.eigen(spark))


@query
def field_projection(spark, sf):
    return rounded(_shares(spark, sf), "c", "q")


@query
def participation_rank(spark, sf):
    return rounded(dimension.ranks(_shares(spark, sf)), "participation", "entropy")


@query
def prefix_select(spark, sf):
    return dimension.select_prefix(_shares(spark, sf), 0.9, 2)


@query
def checkpoint_stability(spark, sf):
    return dimension.checkpoints(_shares(spark, sf), [3, 4, 5, 6], 0.9, 2)


def _field(spark, sf):
    return px.points(spark, sf).select(F.col("vec_id").alias("id"), (F.col("y") + F.cos(F.col("vec_id") * 0.2)).alias("g"), (1 + F.col("vec_id") % 3).cast("double").alias("degree"))


@query
def prefix_bootstrap(spark, sf):
    return dimension.bootstrap_prefix(px.modes(spark, sf), _field(spark, sf), px.eigen(spark), 6, 0.9, 2, seed=50)


@query
def prefix_record(spark, sf):
    return rounded(dimension.bootstrap_record(prefix_bootstrap(spark, sf), 4), "mode_fraction", "exact_fraction", "median")


@query
def mode_records(spark, sf):
    return rounded(dimension.mode_records(_shares(spark, sf), px.eigen(spark), 4), "c", "power", "q", "cumulative")


def _state(spark, sf):
    return spectrum.states(px.modes(spark, sf))


@query
def class_scatter(spark, sf):
    labels = px.points(spark, sf).select(F.col("vec_id").alias("id"), "y")
    return rounded(dimension.class_scatter(_state(spark, sf), labels), "e")


def _gradients(spark, sf):
    return dimension.gate_gradient(_state(spark, sf), px.measurement(spark), 0.4)


@query
def gate_gradient(spark, sf):
    return rounded(_gradients(spark, sf), "p", "grad")


@query
def block_scores(spark, sf):
    return rounded(dimension.block_scores(_gradients(spark, sf), dimension.spectral_blocks(px.eigen(spark))), "score")


@query
def greedy_select(spark, sf):
    s = dimension.block_scores(_gradients(spark, sf), dimension.spectral_blocks(px.eigen(spark)))
    return rounded(dimension.greedy_blocks(s, 0.8), "score", "mass")


def _block_scores(spark, sf):
    return dimension.block_scores(_gradients(spark, sf), dimension.spectral_blocks(px.eigen(spark)))


@query
def ranked_subset(spark, sf):
    return dimension.ranked_subset(_block_scores(spark, sf), 3).select("block", "first", "size", "modes")


@query
def gated_records(spark, sf):
    return rounded(dimension.gated_records(_block_scores(spark, sf), dimension.spectral_blocks(px.eigen(spark)), 0.8), "score", "weight")


@query
def gated_inclusion(spark, sf):
    chosen = dimension.gated_bootstrap(_gradients(spark, sf), dimension.spectral_blocks(px.eigen(spark)), 6, 0.8, seed=60)
    return rounded(dimension.inclusion(chosen, 6), "frequency")


@query
def screening_measurement(spark, sf):
    labels = px.points(spark, sf).select(F.col("vec_id").alias("id"), "y")
    m = dimension.screening_measurement(spectrum.states(px.modes(spark, sf), [1, 3]).withColumn("k", ((F.col("k") + 1) / 2).cast("int")), labels, 2)
    return rounded(dimension.measurement_frame(labels, m[1]), "m")


@query
def probability_decomposition(spark, sf):
    m1 = px.measurement(spark)
    m0 = m1.withColumn("m", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("m") / 3)
    return rounded(readout.decomposition(_state(spark, sf), m0, m1), "p", "diagonal", "diagonal_only", "cross")


@query
def psd_probability(spark, sf):
    return rounded(readout.probability(_state(spark, sf), px.measurement(spark)), "p", "diagonal", "cross")


@query
def fit_predict_small(spark, sf):
    from ..operators.estimator import OrbitalClassifier

    p = px.points(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "y")
    model = OrbitalClassifier(modes=10, betas=(1.0,)).fit(p)
    return rounded(model.predict_proba(p), "p")


# -- evaluation ---------------------------------------------------------------

_EFFICIENCIES = [0.65, 0.7, 0.77, 0.85, 0.9]


@query
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(px.scores(spark, sf)), "auc")


@query
def average_precision(spark, sf):
    return rounded(evaluate.average_precision(px.scores(spark, sf)), "average_precision")


@query
def roc_table(spark, sf):
    return rounded(evaluate.roc_table(px.scores(spark, sf)), "tpr", "fpr", "rejection")


@query
def roc_corners(spark, sf):
    out = evaluate.roc_corners(px.scores(spark, sf))
    return rounded(out.select("method", "threshold", "tp", "fp", "tpr", "fpr"), "tpr", "fpr")


@query
def working_points(spark, sf):
    return rounded(evaluate.working_points(px.scores(spark, sf), _EFFICIENCIES), "threshold", "signal_efficiency", "mistag_rate", "rejection")


@query
def clopper_pearson_bands(spark, sf):
    return rounded(evaluate.with_intervals(evaluate.working_points(px.scores(spark, sf), _EFFICIENCIES)).select("method", "efficiency", "low", "high"), "low", "high")


@query
def probability_metrics(spark, sf):
    return rounded(evaluate.probability_metrics(px.scores(spark, sf)), "log_loss", "brier", "accuracy", "balanced_accuracy", "mcc")


@query
def classification_summary(spark, sf):
    out = evaluate.classification_summary(px.scores(spark, sf))
    return rounded(out, *out.columns[1:])


def _sliced(spark, sf):
    return evaluate.in_slices(px.scores(spark, sf), F.col("pt") / 1000, F.col("eta"))


@query
def slice_auc(spark, sf):
    return rounded(evaluate.roc_auc(_sliced(spark, sf), ("axis", "slice", "method")), "auc")


@query
def slice_efficiency(spark, sf):
    t = evaluate.thresholds(px.scores(spark, sf), [0.7])
    out = evaluate.working_points(_sliced(spark, sf), [0.7], ("axis", "slice", "method"), t)
    return out.select("axis", "slice", "method", "selected", "mistags", r6("signal_efficiency"), r6("mistag_rate")).toDF("axis", "slice", "method", "selected", "mistags", "signal_efficiency", "mistag_rate")


@query
def efficiency_pivot(spark, sf):
    out = artifacts.comparison_table(evaluate.working_points(px.scores(spark, sf), _EFFICIENCIES), _EFFICIENCIES)
    return rounded(out, *out.columns[1:])


@query
def rejection_ratio(spark, sf):
    w = evaluate.working_points(px.scores(spark, sf), _EFFICIENCIES).select("method", "efficiency", "rejection")
    a, b = (w.where(F.col("method") == m).select("efficiency", F.col("rejection").alias(m)) for m in "ab")
    return a.join(b, "efficiency").select("efficiency", r6(sc.finite_ratio(F.col("b"), F.col("a")), "ratio"))


@query
def score_validity(spark, sf):
    row = F.col("source_row")
    odd = F.when(row % 23 == 0, F.lit(float("nan"))).when(row % 29 == 0, F.lit(-0.1)).when(row % 31 == 0, F.lit(None)).when(row % 37 == 0, F.lit(float("inf")))
    return evaluate.score_validity(px.scores(spark, sf).withColumn("score", F.when(odd.isNotNull() | (row % 31 == 0), odd).otherwise(F.col("score"))))


@query
def visible_points(spark, sf):
    t = evaluate.visible(evaluate.roc_table(px.scores(spark, sf)))
    return t.groupBy("method").agg(F.count("*").alias("n"), r6(F.max("rejection"), "most"))


@query
def roc_bands(spark, sf):
    bands = evaluate.roc_bands(px.scores(spark, sf))
    names = ["tpr_low", "tpr_high", "fpr_low", "fpr_high", "rejection_low", "rejection_high"]
    return rounded(bands.select("method", "threshold", "tp", "fp", *names), *names)


@query
def enough_points(spark, sf):
    j = px.jets(spark, sf).select("source_row", "event_number")
    return evaluate.enough_points(j, "source_row", 400)


@query
def aligned_comparison(spark, sf):
    s = px.scores(spark, sf)
    each = {f"score_{m}": s.where(F.col("method") == m).select(*align.KEYS, "score") for m in "ab"}
    return artifacts.read_comparison(spark, px.two_flavours(spark, sf).select(*align.KEYS), each)


@query
def aligned_states(spark, sf):
    rows = px.two_flavours(spark, sf).select(*align.KEYS)
    phi = rows.select(*align.KEYS, (F.col("source_row") % 7 / 8).alias("phi_2"), (F.col("source_row") % 5 / 4).alias("phi_10"), (F.col("y") - 0.5).alias("phi_1"))
    return artifacts.align_states(rows, phi)


@query
def feature_join(spark, sf):
    j = px.jets(spark, sf).select("source_row", "pt")
    t = px.tracks(spark, sf).groupBy(F.col("jet").alias("source_row")).agg(r6(F.max("s"), "most"))
    return artifacts.with_features(j, t)


@query
def metric_intervals(spark, sf):
    s = px.scores(spark, sf)
    low = bootstrap.interval_table(bootstrap.event_bootstrap_auc(s.where("method = 'a'"), 8)).where("metric = 'auc'").drop("metric")
    return rounded(artifacts.metric_intervals(evaluate.roc_auc(s), low), "auc", "lower", "upper", "se")


@query
def spearman_matrix(spark, sf):
    t = px.tracks(spark, sf)
    return rounded(evaluate.spearman(t, ["s", "z"], ["u", "v", "hits"]), "rho")


@query
def best_feature_per_group(spark, sf):
    rho = evaluate.spearman(px.tracks(spark, sf), ["s", "z"], ["u", "v", "hits"])
    return rounded(evaluate.best_per_group(rho, ["left"], "rho", "right"), "rho")


@query
def class_summary(spark, sf):
    out = evaluate.class_summary(px.scores(spark, sf), "score", ["method", "y"])
    return rounded(out, "mean", "std", "q16", "median", "q84")


@query
def class_summary_population(spark, sf):
    out = evaluate.class_summary(px.scores(spark, sf), "score", ["method", "y"], sample=False)
    return rounded(out, "mean", "std", "q16", "median", "q84")


@query
def histogram_1d(spark, sf):
    return rounded(evaluate.histogram(px.tracks(spark, sf), "s", -3.0, 5.0, 44, ["hits"]), "density")


def _grid(spark, sf):
    return evaluate.histogram_2d(px.tracks(spark, sf), "s", "z", (-3.0, 5.0), (-3.0, 3.0), 12)


@query
def histogram_2d(spark, sf):
    return _grid(spark, sf)


@query
def smoothed_grid(spark, sf):
    return rounded(evaluate.smoothed(_grid(spark, sf), 12), "n")


@query
def enclosed_mass(spark, sf):
    return evaluate.enclosed_level(_grid(spark, sf), 0.68)


@query
def hard_negatives(spark, sf):
    return readout.hard_examples(px.scores(spark, sf).where("method = 'a'"), 50, "source_row").select("source_row", "y", "place")


# -- bootstrap ----------------------------------------------------------------


@query
def event_bootstrap_auc(spark, sf):
    return rounded(bootstrap.event_bootstrap_auc(px.scores(spark, sf), 8), "auc")


@query
def paired_auc_difference(spark, sf):
    rows = stored(bootstrap.event_bootstrap_auc(px.scores(spark, sf), 8))
    return rounded(bootstrap.paired_difference(rows, "a"), "mean", "low", "high", "p")


@query
def event_bootstrap_metrics(spark, sf):
    out = bootstrap.event_bootstrap_metrics(px.scores(spark, sf), 8)
    return rounded(out, *out.columns[2:])


def _stratified(spark, sf):
    return bootstrap.stratified_bootstrap(px.scores(spark, sf), 4, most=4000)


@query
def stratified_bootstrap_auc(spark, sf):
    out = _stratified(spark, sf)
    return rounded(out, *out.columns[2:])


@query
def stratified_intervals(spark, sf):
    return rounded(bootstrap.interval_table(_stratified(spark, sf)), "lower", "upper", "se", digits=9)


@query
def bootstrap_summary(spark, sf):
    out = bootstrap.bootstrap_summary(bootstrap.event_bootstrap_auc(px.scores(spark, sf), 8))
    return rounded(out, *out.columns[1:])


# -- selection ----------------------------------------------------------------


def _arms(spark, sf):
    """Customers' nations as candidate models: score, size, lower bound, modes, selected set, bank."""
    c = px.table(spark, sf, "customer")
    arms = c.groupBy(F.col("c_nationkey").alias("arm")).agg(F.round(F.avg("c_acctbal"), 2).alias("score"), F.count("*").alias("size"))
    return arms.select("*", F.round(F.col("score") - 100 * (F.col("arm") % 4), 2).alias("lower"), (F.col("size") % 4).alias("k"), (F.col("arm") % 3).alias("bank"))


@query
def screen_topk(spark, sf):
    return selection.screen(_arms(spark, sf).select("arm", "score", "size"), 5)


@query
def arm_selection(spark, sf):
    return selection.least_by(_arms(spark, sf), F.col("k"), F.col("lower").desc(), F.col("arm")).select("arm", "k", "lower")


@query
def one_percent_select(spark, sf):
    return selection.simplest_equivalent(_arms(spark, sf), share=0.9).select("arm", "lower", "score", "size")


@query
def arm_dedup(spark, sf):
    every = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))
    arms = _arms(spark, sf).withColumn("chosen", F.concat(F.filter(every, lambda x: x <= F.col("k") % 2), F.filter(every, lambda x: x == F.col("size") % 2)))
    return selection.distinct_sets(arms, "bank", "chosen").withColumn("chosen", F.array_join("chosen", ","))
