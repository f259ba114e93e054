"""SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

from . import proxies as px

ORACLES: dict[str, str] = {}


def sql(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = (f"WITH {ctes} " if ctes else "") + body


def count(x: str) -> str:
    return f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)::BIGINT"


_FID = "pt / 1000 > 20 AND pt / 1000 < 250 AND abs(eta) < 2.5 AND label_raw IN (0, 5)"
sql("fiducial_filter", px.JETS, f"SELECT * FROM jets WHERE {_FID}")
_ODD = px.JETS + ", odd AS (SELECT source_row, event_number, label_raw, CASE WHEN source_row % 13 = 0 THEN NULL WHEN source_row % 17 = 0 THEN 'infinity'::DOUBLE ELSE pt END AS pt, CASE WHEN source_row % 19 = 0 THEN 'nan'::DOUBLE ELSE eta END AS eta FROM jets)"
_KNOWN = "coalesce(isfinite(pt) AND isfinite(eta), false)"
sql("fiducial_audit", _ODD, f"SELECT count(*) AS n_rows, {count(_KNOWN)} AS n_finite, {count('label_raw IN (0, 5)')} AS n_flavour, {count(_KNOWN + ' AND ' + _FID)} AS n_pass FROM odd")
sql("fiducial_pilot", _ODD, f"SELECT source_row, label_raw FROM odd WHERE {_KNOWN} AND label_raw IN (0, 5)")
sql("event_cap", px.JETS + ", ev AS (SELECT DISTINCT event_number FROM jets), " + px.splitmix("ev", "event_number", 1701, "hashed"), "SELECT source_row, event_number FROM jets WHERE event_number IN (SELECT event_number FROM hashed ORDER BY h >> 1, event_number LIMIT 300)")
sql("label_encoding", px.JETS + ", t AS (SELECT CASE WHEN label_raw = 5 THEN ' S ' WHEN source_row % 2 = 0 THEN 'Background' WHEN source_row % 3 = 0 THEN '0.0' ELSE 'b' END AS label FROM jets)", "SELECT label, CASE lower(trim(label)) WHEN 's' THEN 1 WHEN 'b' THEN 0 WHEN 'background' THEN 0 WHEN '0.0' THEN 0 END AS y, count(*) AS n FROM t GROUP BY 1, 2")
sql("label_encoding_by_order", "", "SELECT o_orderstatus, CASE WHEN o_orderstatus = (SELECT max(o_orderstatus) FROM orders WHERE o_orderstatus <> 'P') THEN 1 ELSE 0 END AS y, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
sql("sentinel_clean", "", "SELECT event_type, count(*) AS n, count(v) AS n_clean, round(sum(v), 6) AS total FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1")
_ROLE = "CASE WHEN event_number % 10 <= 5 THEN 'base' WHEN event_number % 10 <= 7 THEN 'operator' WHEN event_number % 10 = 8 THEN 'dimension' ELSE 'test' END"
sql("mod10_roles", px.JETS, f"SELECT source_row, {_ROLE} AS role FROM jets")
sql("role_audit", px.BL, f"SELECT {_ROLE} AS role, count(*) AS n_rows, count(DISTINCT event_number) AS n_events, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, sum(('0x' || substr(sha256(source_row::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM bl GROUP BY 1")
sql("role_overlap", px.BL + f", r AS (SELECT DISTINCT event_number, CASE WHEN source_row % 50 = 0 THEN 'extra' ELSE {_ROLE} END AS role FROM bl)", 'SELECT a.role AS "left", b.role AS "right", count(*) AS shared FROM r a JOIN r b USING (event_number) WHERE a.role < b.role GROUP BY 1, 2')
sql("partition_check", px.JETS + ", r AS (SELECT source_row FROM jets WHERE source_row % 97 <> 0 UNION ALL SELECT source_row FROM jets WHERE source_row % 31 = 0), p AS (SELECT source_row, count(*) AS n FROM r GROUP BY 1)", f"SELECT {count('n > 1')} AS repeated, (SELECT count(*) FROM jets) - count(*) AS missing FROM p")
sql("splitmix_split", px.JETS + ", ev AS (SELECT DISTINCT event_number FROM jets), " + px.splitmix("ev", "event_number", 17, "h1") + ", " + px.splitmix("ev", "event_number", 5, "h2"), "SELECT h1.event_number, (h1.h % 2)::INT AS half, CASE WHEN h2.h % 10000 < 3000 THEN 1 ELSE 0 END AS inner FROM h1 JOIN h2 USING (event_number)".replace("AS inner", 'AS "inner"'))
def ranked(name: str, source: str, seed: int, key: str = "source_row", by: str = "y") -> str:
    """CTEs that give ``name``: rows with their rank r by hash within the class."""
    return px.splitmix(source, key, seed, f"{name}_h") + f", {name} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY h >> 1, {key}) AS r FROM {name}_h)"


_LEAST = "least(sum(y), sum(1 - y))"
sql("balanced_sample", px.BL + ", " + ranked("k", "bl", 3), f"SELECT source_row, y FROM k WHERE r <= (SELECT {_LEAST} FROM bl)")
_URGENT = "u AS (SELECT o_orderkey AS source_row, o_custkey AS event_number, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders), n AS (SELECT sum(y) AS n1, sum(1 - y) AS n0, count(*) AS n FROM u)"
sql("stratified_take", _URGENT + ", " + ranked("k", "u", 9) + ", want AS (SELECT least(n1, 8000 - least(n0, 4000)) AS k1, least(n0, 8000 - least(n1, 8000 - least(n0, 4000))) AS k0 FROM n)", "SELECT source_row, y FROM k, want WHERE r <= CASE WHEN y = 1 THEN k1 ELSE k0 END")


def share(size: str, n1: str = "n1", n: str = "n", n0: str = "n0") -> str:
    """Rows of class 1 in a sample of this size with the shares of the classes."""
    return f"least({n1}, greatest({size} - {n0}, (2 * {size} * {n1} + {n}) // (2 * {n})))"


sql("stratified_limit", _URGENT + ", " + ranked("k", "u", 11), f"SELECT source_row, y FROM k, n WHERE r <= CASE WHEN y = 1 THEN {share('700')} ELSE 700 - {share('700')} END")
_TEST = "round_even(0.25 * n, 0)"
sql("random_split", _URGENT + ", " + ranked("k", "u", 12), f"SELECT source_row, CASE WHEN r <= CASE WHEN y = 1 THEN {share(_TEST + '::BIGINT')} ELSE {_TEST} - {share(_TEST + '::BIGINT')} END THEN 'test' ELSE 'development' END AS role FROM k, n")
_B1, _B2, _B3 = (share(str(k)) for k in (600, 200, 101))
sql("fixed_roles", _URGENT + ", " + ranked("k", "u", 13) + f", e AS (SELECT {_B1} AS a1, {_B2} AS b1, {_B3} AS c1 FROM n), q AS (SELECT k.*, CASE WHEN y = 1 THEN a1 ELSE 600 - a1 END AS a, CASE WHEN y = 1 THEN a1 + b1 ELSE 800 - a1 - b1 END AS b, CASE WHEN y = 1 THEN a1 + b1 + c1 ELSE 901 - a1 - b1 - c1 END AS c FROM k, e)", "SELECT source_row, y, CASE WHEN r <= a THEN 'base' WHEN r <= b THEN 'operator' ELSE 'audit' END AS role FROM q WHERE r <= c")
_GROUPED = px.BL + ", gb AS (SELECT *, event_number * 2 + y AS grp FROM bl), grp AS (SELECT DISTINCT grp, y FROM gb)"
sql("group_limit", _GROUPED + ", " + ranked("k", "grp", 14, "grp") + ", n AS (SELECT sum(y) AS n1, sum(1 - y) AS n0, count(*) AS n, (SELECT count(*) FROM gb) AS rows FROM grp), w AS (SELECT *, least(greatest(round_even(n * 500.0 / rows, 0), 2), n - 1)::BIGINT AS w FROM n)", f"SELECT source_row, gb.grp FROM gb JOIN k USING (grp), w WHERE rows <= 500 OR r <= CASE WHEN k.y = 1 THEN {share('w')} ELSE w - {share('w')} END")
sql("group_holdout", _GROUPED + ", " + ranked("k", "grp", 4, "grp") + ", f AS (SELECT ((r - 1) % 5)::INT AS fold, gb.y FROM gb JOIN k USING (grp)), t AS (SELECT count(*) AS n, avg(y) AS p FROM bl), e AS (SELECT fold, count(*) AS n, abs(count(*) / any_value(t.n) - 0.2::DOUBLE) AS size_error, abs(avg(y) - any_value(t.p)) AS balance_error FROM f, t GROUP BY 1)", "SELECT fold, n, round(size_error, 6) AS size_error, round(balance_error, 6) AS balance_error, row_number() OVER (ORDER BY round(size_error + balance_error, 12), fold) = 1 AS best FROM e")
sql("tail_split", px.BL + ", n AS (SELECT count(*) AS n FROM jets)", "SELECT CASE WHEN source_row >= n - n // 5 THEN 'test' ELSE 'development' END AS role, count(*) AS n, sum(y)::BIGINT AS n_pos FROM bl, n GROUP BY 1")
sql("event_halves", px.JETS + ", ev AS (SELECT event_number, count(*) AS n FROM jets GROUP BY 1), " + px.splitmix("ev", "event_number", 21, "hashed"), "SELECT event_number, (h % 2)::INT AS half, n FROM hashed")
sql("missing_classes", px.BL + f", r AS (SELECT y, {_ROLE} AS role FROM bl)", "SELECT role, count(DISTINCT y) AS n_classes FROM r WHERE role <> 'test' OR y = 1 GROUP BY 1 HAVING count(DISTINCT y) < 2")
_SV = px.BL + f", a AS (SELECT source_row, event_number, CASE WHEN source_row % 211 = 0 THEN 'test' ELSE {_ROLE} END AS role, CASE WHEN source_row % 3 = 0 THEN 'encoder' WHEN source_row % 5 = 0 THEN 'early_stop' END AS part FROM bl), r AS (SELECT * FROM a WHERE source_row % 97 <> 0 UNION ALL SELECT * FROM a WHERE source_row % 31 = 0)"
_OWN = "CASE role WHEN 'base' THEN event_number % 10 <= 5 WHEN 'operator' THEN event_number % 10 IN (6, 7) WHEN 'dimension' THEN event_number % 10 = 8 ELSE event_number % 10 = 9 END"
_OUTSIDE = "part IS NOT NULL AND role <> 'base'"
_SHARED = "(SELECT count(*) FROM (SELECT DISTINCT {0}, event_number FROM r WHERE {0} IS NOT NULL) x JOIN (SELECT DISTINCT {0}, event_number FROM r WHERE {0} IS NOT NULL) z ON x.event_number = z.event_number AND x.{0} < z.{0})"
sql("split_violations", _SV, f"SELECT (SELECT count(*) FROM (SELECT source_row FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM jets) - count(DISTINCT source_row) AS missing, {count('source_row < 0')} AS negative, {count('NOT (' + _OWN + ')')} AS wrong_residue, {count(_OUTSIDE)} AS outside, {_SHARED.format('role')} AS shared_events, {_SHARED.format('part')} AS shared_part_events FROM r")
_SCAN = f"picked AS (SELECT source_row, event_number, CASE WHEN label_raw = 5 THEN 1 ELSE 0 END AS y FROM {{}} WHERE {_KNOWN} AND {_FID}), " + ranked("k", "picked", 3) + f", idx AS (SELECT source_row, event_number, y, {_ROLE} AS role FROM k WHERE r <= (SELECT {_LEAST} FROM picked))"
sql("jet_index", _ODD + ", " + _SCAN.format("odd"), "SELECT * FROM idx")
sql("labels_and_events", px.JETS + ", " + _SCAN.format("jets"), "SELECT source_row, event_number, y FROM idx")
sql("anti_landmarks", px.JETS, f"SELECT label_raw, {count('source_row % 3 <> 0')} AS n_rest, {count('source_row % 3 = 0')} AS n_marks FROM jets GROUP BY 1")
sql("set_operations", px.JETS + ", a AS (SELECT event_number FROM jets WHERE event_number % 2 = 0), b AS (SELECT event_number FROM jets WHERE event_number % 3 = 0)", "SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS stacked, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(DISTINCT event_number) FROM jets) AS events")
sql("group_hash", "", "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM documents GROUP BY text) GROUP BY 1")
sql("group_audit", "g AS (SELECT count(*) AS n FROM documents GROUP BY text)", "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicated, max(n) AS largest FROM g")
sql("group_conflicts", "", "SELECT sha256(text) AS g, count(DISTINCT toxic) AS n_labels, count(*) AS n_rows FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT toxic) > 1")
_WIDE = "wide AS (SELECT source_row, event_number, y, max(score) FILTER (method = 'a') AS score_a, max(score) FILTER (method = 'b') AS score_b FROM scores GROUP BY 1, 2, 3)"
sql("align_predictions", px.SCORES + ", " + _WIDE, "SELECT * FROM wide")
sql("alignment_faults", px.SCORES + ", f AS (SELECT source_row, CASE WHEN source_row % 17 = 0 THEN 1.5 ELSE score END AS score FROM scores WHERE method = 'a' AND source_row % 13 <> 0), g AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE source_row % 19 = 0), j AS (SELECT b.source_row, g.score, g.source_row IS NULL AS gone FROM bl b LEFT JOIN g USING (source_row))", f"SELECT {count('gone')} AS unmatched, {count('score > 1 OR score < 0')} AS invalid, 0::BIGINT AS repeated_left, (SELECT count(*) FROM (SELECT source_row FROM g GROUP BY 1 HAVING count(*) > 1)) AS repeated_right FROM j")
sql("paired_mistag", px.SCORES + ", " + _WIDE + ", c AS (SELECT " + ", ".join(f"{count(x)} AS {n}" for n, x in (("both", "score_a >= 0.6 AND score_b >= 0.6"), ("only_a", "score_a >= 0.6 AND score_b < 0.6"), ("only_b", "score_a < 0.6 AND score_b >= 0.6"), ("neither", "score_a < 0.6 AND score_b < 0.6"))) + " FROM wide WHERE y = 0)", 'SELECT "both", only_a, only_b, neither, round(least(1, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, least(only_a, only_b) + 1) t(i))), 6) AS p_value FROM c'.replace("range(0, least(only_a, only_b) + 1) t(i)", "(SELECT unnest(range(0, least(only_a, only_b) + 1)) AS i)"))
sql("same_label_check", px.BL, f"SELECT count(*) AS n_rows, {count('source_row % 101 = 0')} AS n_conflicts FROM bl")

# -- tracks -------------------------------------------------------------------
sql("track_topk", px.TRACKS, "SELECT jet, place, slot, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY jet ORDER BY -abs(s), slot) AS place FROM tracks) WHERE place <= 3")
sql("track_transform", px.TRACKS, "SELECT jet, slot, round(sign(u) * ln(1 + abs(u / 100 * 1000)), 6) AS q, round(sign(s) * ln(1 + abs(s)), 6) AS d, round(ln(1 + greatest(v, 0)), 6) AS w FROM tracks")
_QS = (10, 25, 50, 75, 90)
_ODD_TRACKS = px.TRACKS + ", odd_tracks AS (SELECT * REPLACE (CASE WHEN (jet + slot) % 5 = 0 THEN 'infinity'::DOUBLE WHEN (jet + slot) % 7 = 0 THEN 'nan'::DOUBLE WHEN (jet + slot) % 11 = 0 THEN NULL ELSE s END AS s) FROM tracks)"
sql("track_summary", _ODD_TRACKS, "SELECT o_orderkey AS jet, " + ", ".join(f"round(coalesce(avg({f}) FILTER (isfinite({f})), 0), 9) AS {f}_mean, round(coalesce(stddev_pop({f}) FILTER (isfinite({f})), 0), 9) AS {f}_std" for f in "sz") + ", " + ", ".join(f"round(coalesce(quantile_cont({f}, {q / 100}) FILTER (isfinite({f})), 0), 9) AS {f}_q{q}" for f in "sz" for q in _QS) + " FROM orders LEFT JOIN odd_tracks ON jet = o_orderkey GROUP BY 1")
sql("jet_summaries", px.JETS + ", " + px.TRACKS + ", " + _SCAN.format("jets"), "SELECT source_row, role, round(coalesce(avg(z), 0), 9) AS z_mean, round(coalesce(quantile_cont(z, 0.5), 0), 9) AS z_q50 FROM idx LEFT JOIN tracks ON jet = source_row GROUP BY 1, 2")
sql("jet_batches", px.JETS + ", " + px.TRACKS + ", " + _SCAN.format("jets") + ", t AS (SELECT *, row_number() OVER (PARTITION BY jet ORDER BY abs(s) DESC, slot) - 1 AS place, count(*) OVER (PARTITION BY jet) AS n FROM tracks)", "SELECT source_row, n::DOUBLE AS n_tracks, place, round(s, 6) AS s, round(z, 6) AS z FROM idx JOIN t ON jet = source_row WHERE place < 2")
_JF = {"max_abs_d0_significance": "max(abs(s))", "mean_top3_abs_d0_significance": "avg(abs(s)) FILTER (slot <= 3)", "max_abs_z0_significance": "max(abs(z))", "track_angular_rms": "sqrt(avg(u * u + v * v))", "mean_abs_deta": "avg(abs(u))", "mean_abs_dphi": "avg(abs(v))", "mean_abs_q_over_p": "avg(abs(z))", "mean_pixel_hits": "avg(hits)", "mean_sct_hits": "avg(slot)", "mean_shared_hits": "avg(hits + slot)", "mean_split_hits": "avg(hits)", "jet_log_pt": "ln(1 + any_value(j.pt) / 1000)", "jet_abs_eta": "abs(any_value(j.eta))", "tracks_used": "count(slot)", "tracks_total": "count(slot)"}
sql("jet_features", px.JETS + ", " + px.TRACKS, "SELECT source_row, " + ", ".join(f"round(coalesce({e}, 0)::DOUBLE, 9) AS {n}" for n, e in _JF.items()) + " FROM jets j LEFT JOIN tracks ON jet = source_row GROUP BY 1")
sql("jet_context", px.JETS + ", n AS (SELECT l_orderkey AS source_row, count(*) AS n FROM lineitem GROUP BY 1)", "SELECT source_row, round(ln(1 + greatest(pt / 1000, 0)), 6) AS log_pt, round(eta, 6) AS eta, round(abs(eta), 6) AS abs_eta, round(coalesce(n, 0)::DOUBLE, 6) AS n_tracks FROM jets LEFT JOIN n USING (source_row)")
sql("jet_observables", px.TRACKS + ", t AS (SELECT *, row_number() OVER (PARTITION BY jet ORDER BY abs(s) DESC, slot) AS place FROM tracks)", "SELECT o_orderkey AS jet, round(coalesce(max(abs(s)), 0), 9) AS max_significance, round(coalesce(avg(abs(s)), 0), 9) AS mean_significance, round(coalesce(avg(abs(s)) FILTER (place <= 3), 0), 9) AS top3_significance, round(coalesce(sqrt(avg(u * u + v * v)), 0), 9) AS angular_rms, round(coalesce(sum(hits), 0)::DOUBLE, 9) AS hit_sum FROM orders LEFT JOIN t ON jet = o_orderkey GROUP BY 1")
_REL = px.TRACKS + ", rel AS (SELECT a.jet, a.slot AS i, b.slot AS j, (a.s - b.s) ** 2 + (a.z - b.z) ** 2 + (a.u - b.u) ** 2 + (a.v - b.v) ** 2 AS d2 FROM tracks a JOIN tracks b ON a.jet = b.jet AND a.slot <> b.slot)"
sql("track_relation", _REL, "SELECT jet, i, j, round(d2, 6) AS d2 FROM rel")
sql("local_adjacency", _REL + ", near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jet, i ORDER BY d2, j) AS k FROM rel) WHERE k <= 2)", "SELECT jet, i, j, round(exp(-0.5 * least(d2, 50)) / sum(exp(-0.5 * least(d2, 50))) OVER (PARTITION BY jet, i), 6) AS w FROM near")
_PAR = _REL + ", par AS (SELECT jet, i, j, (exp(-least(d2 / 4.5, 50)) + 1e-6) / sum(exp(-least(d2 / 4.5, 50)) + 1e-6) OVER (PARTITION BY jet, i) AS w FROM rel)"
sql("parallel_adjacency", _PAR, "SELECT jet, i, j, round(w, 6) AS w FROM par")
sql("sequential_messages", _PAR + ", m1 AS (SELECT p.jet, p.i AS slot, sum(p.w * t.s) AS s FROM par p JOIN tracks t ON t.jet = p.jet AND t.slot = p.j GROUP BY 1, 2), m2 AS (SELECT p.jet, p.i AS slot, sum(p.w * m1.s) AS s FROM par p JOIN m1 ON m1.jet = p.jet AND m1.slot = p.j GROUP BY 1, 2)", "SELECT jet, slot, 1 AS step, round(s, 6) AS s FROM m1 UNION ALL SELECT jet, slot, 2, round(s, 6) FROM m2")

_NEAR = ", near AS (SELECT jet, i, j, exp(-0.5 * least(d2, 50)) / sum(exp(-0.5 * least(d2, 50))) OVER (PARTITION BY jet, i) AS w FROM (SELECT *, row_number() OVER (PARTITION BY jet, i ORDER BY d2, j) AS k FROM rel) WHERE k <= 2)"


def message(name: str, adjacency: str, source: str, fields: str) -> str:
    """A CTE: the adjacency applied to fields of the source, 0 without neighbours."""
    sums = ", ".join(f"coalesce(sum(a.w * x.{f}), 0) AS {f}" for f in fields)
    return f", {name} AS (SELECT t.jet, t.slot, {sums} FROM tracks t LEFT JOIN {adjacency} a ON a.jet = t.jet AND a.i = t.slot LEFT JOIN {source} x ON x.jet = a.jet AND x.slot = a.j GROUP BY 1, 2)"


def placed(values: list[str], joins: str) -> str:
    return " UNION ALL ".join(f"SELECT t.jet, t.slot, {k} AS place, round({v}, 6) AS value FROM tracks t {joins}" for k, v in enumerate(values))


_JOIN = "JOIN {0} USING (jet, slot)"
sql("node_inputs_set", px.TRACKS, placed(["t.s", "t.z"], ""))
_FOUR = ["t.s", "t.z", "m.s", "m.z", "t.s - m.s", "t.z - m.z", "t.s * m.s", "t.z * m.z"]
sql("node_inputs_graph", _REL + _NEAR + message("m", "near", "tracks", "sz"), placed(_FOUR, _JOIN.format("m")))
sql("node_inputs_parallel", _PAR + message("m", "par", "tracks", "sz"), placed(_FOUR, _JOIN.format("m")))
_SEQ = _REL + _NEAR + message("m1", "near", "tracks", "s") + message("m2", "near", "m1", "s")
sql("node_inputs_sequential", _SEQ, placed(["t.s", "m1.s", "m2.s"], _JOIN.format("m1") + " " + _JOIN.format("m2")))
sql("node_inputs_hybrid", _SEQ + _PAR[len(_REL) :] + message("b", "par", "tracks", "s"), placed(["t.s", "m1.s", "m2.s", "b.s", "t.s - b.s"], " ".join(_JOIN.format(m) for m in ("m1", "m2", "b"))))
sql("dropout_shift", px.TRACKS + ", " + px.splitmix("tracks", "jet * 1000 + slot - 1", 5, "hashed") + ", k AS (SELECT jet, slot, s, h % 10000 < 7000 AS ok, bool_or(h % 10000 < 7000) OVER (PARTITION BY jet) AS any_ok FROM hashed), d AS (SELECT jet, abs(1 / (1 + exp(-avg(s))) - 1 / (1 + exp(-avg(s) FILTER (ok OR (NOT any_ok AND slot = 1))))) AS d FROM k GROUP BY 1)", "SELECT count(*) AS n, round(quantile_cont(d, 0.95), 6) AS p95_shift, round(avg(d), 6) AS mean_shift FROM d")

# -- scalars and feature maps -------------------------------------------------
sql("discriminants", "p AS (SELECT DISTINCT l_discount AS pb, l_tax AS pu, l_quantity / 100 AS pc FROM lineitem)", "SELECT pb, pu, pc, round(CASE WHEN pb + pu > 0 THEN pb / (pb + pu) ELSE 0.5 END, 6) AS \"binary\", round(ln(greatest(pb, 1e-12) / greatest(0.2::DOUBLE * pc + 0.05::DOUBLE * 0.01::DOUBLE + 0.75::DOUBLE * pu, 1e-12)), 6) AS gn2, round(ln(greatest(pb, 1e-12) / greatest(0.018::DOUBLE * pc + 0.982::DOUBLE * pu, 1e-12)), 6) AS dl1 FROM p")
_W = "atan2(sin(a.phi - a.phi2), cos(a.phi - a.phi2))"
sql("pair_kinematics", px.JETS + ", a AS (SELECT source_row, pt / 1000 AS pt1, eta AS eta1, eta * 1.3::DOUBLE AS phi, pt / 1000 * 0.7::DOUBLE + 5 AS pt2, -eta / 2 AS eta2, eta * 1.3::DOUBLE * 2 + 1 AS phi2 FROM jets), b AS (SELECT *, atan2(sin(phi - phi2), cos(phi - phi2)) AS dphi, eta1 - eta2 AS deta, atan2(sin(2 * phi), cos(2 * phi)) AS mphi, pt1 / 2 + 3 AS met FROM a)", "SELECT source_row, round(abs(dphi), 6) AS abs_dphi, round(cos(dphi), 6) AS cos_dphi, round(deta, 6) AS deta, round(sqrt(dphi * dphi + deta * deta), 6) AS dr, round(sqrt(greatest(2 * pt1 * pt2 * (cosh(deta) - cos(dphi)), 0)), 6) AS mass, round(ln(pt1 / pt2), 6) AS log_pt_ratio, round(abs(mphi), 6) AS met_abs_dphi, round(cos(mphi), 6) AS met_cos_dphi, round(sqrt(greatest(2 * pt1 * met * (1 - cos(mphi)), 0)), 6) AS met_mt, CASE WHEN source_row % 4 = 0 THEN 0 WHEN source_row % 4 = 1 THEN 1 ELSE 2 END AS topology FROM b")
sql("periodic_angles", px.JETS, "SELECT source_row, round(sin(eta * 3 - eta), 6) + 0 AS phi_sin, round(cos(eta * 3 - eta), 6) + 0 AS phi_cos, round(atan2(sin(eta * 5), cos(eta * 5)), 6) + 0 AS wrapped FROM jets")
sql("finite_ratio", "", "SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE round(p_retailprice / (p_size - 10), 6) END AS ratio FROM part")
sql("robust_scale", px.TRACKS + ", q AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.1) AS {f}1, quantile_cont({f}, 0.5) AS {f}5, quantile_cont({f}, 0.9) AS {f}9" for f in "sz") + " FROM tracks)", "SELECT jet, slot, " + ", ".join(f"round(least(greatest(({f} - {f}5) / ({f}9 - {f}1), -12), 12), 6) AS {f}" for f in "sz") + " FROM tracks, q")
sql("standard_scale", px.JETS + ", m AS (SELECT median(pt) AS m FROM jets WHERE source_row % 9 <> 0), f AS (SELECT source_row, CASE WHEN source_row % 9 = 0 THEN m ELSE pt END AS pt, eta FROM jets, m), s AS (SELECT avg(pt) AS pm, stddev_pop(pt) AS ps, avg(eta) AS em, stddev_pop(eta) AS es FROM f)", "SELECT source_row, round((pt - pm) / ps, 6) AS pt, round((eta - em) / es, 6) AS eta FROM f, s")
sql("median_impute_flags", px.JETS + ", m AS (SELECT median(pt) AS m FROM jets WHERE source_row % 9 <> 0), f AS (SELECT source_row, CASE WHEN source_row % 9 = 0 THEN m ELSE pt END AS pt, eta, CASE WHEN source_row % 9 = 0 THEN 1.0 ELSE 0.0 END AS pt_missing FROM jets, m), q AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.1) AS {f}1, quantile_cont({f}, 0.5) AS {f}5, quantile_cont({f}, 0.9) AS {f}9" for f in ("pt", "eta")) + " FROM f)", "SELECT source_row, round(least(greatest((pt - pt5) / (pt9 - pt1), -10), 10), 6) AS pt, round(least(greatest((eta - eta5) / (eta9 - eta1), -10), 10), 6) AS eta, pt_missing::DOUBLE AS pt_missing FROM f, q")

sql("log_if_positive", px.JETS, "SELECT source_row, round(ln(1 + pt), 6) AS pt__log1p FROM jets")


def scaled(name: str, source: str, columns: dict[str, str], extra: str = "") -> str:
    """CTEs that give ``name``: columns (SQL over the source) with medians for nulls, robustly scaled and cut at 10."""
    filled = ", ".join(f"coalesce({e}, (SELECT median({e}) FROM {source})) AS {c}" for c, e in columns.items())
    q = ", ".join(f"quantile_cont({c}, 0.1) AS {c}_a, median({c}) AS {c}_m, quantile_cont({c}, 0.9) AS {c}_b" for c in columns)
    out = ", ".join(f"round(least(greatest(({c} - {c}_m) / CASE WHEN {c}_b > {c}_a THEN {c}_b - {c}_a ELSE 1 END, -10), 10), 6) + 0 AS {c}" for c in columns)
    return f"{name}_f AS (SELECT id, {filled}{extra} FROM {source}), {name}_q AS (SELECT {q} FROM {name}_f), {name} AS (SELECT id, {out}" + "".join(f", {c.split(' AS ')[1]}" for c in extra.split(", ")[1:]) + f" FROM {name}_f, {name}_q)"


sql("susy_map", px.SUSY + ", " + scaled("m", "susy", {"lep1_pt": "lep1_pt", "M_R": "M_R", "sin_lep1_phi": "sin(lep1_phi)", "cos_dphi_lep1_met": "cos(lep1_phi - missing_phi)", "M_R_missing": "CASE WHEN M_R IS NULL THEN 1.0::DOUBLE ELSE 0 END", "sin_dphi_lep2_met": "sin(lep2_phi - missing_phi)"}), "SELECT * FROM m")
sql("higgs_compact_map", px.HIGGS + ", " + scaled("m", "higgs", {"DER_mass": "DER_mass", "PRI_tau_pt": "PRI_tau_pt", "sin_dphi_PRI_tau_met": "sin(PRI_tau_phi - PRI_met_phi)", "cos_dphi_PRI_jet_leading_met": "cos(PRI_jet_leading_phi - PRI_met_phi)"}, ", (DER_mass IS NULL)::INT::DOUBLE AS missing__DER_mass, (PRI_jet_leading_phi IS NULL)::INT::DOUBLE AS missing__PRI_jet_leading_phi"), "SELECT * FROM m")
_DR = "sqrt(atan2(sin(PRI_tau_phi - PRI_lep_phi), cos(PRI_tau_phi - PRI_lep_phi)) ** 2 + (PRI_tau_eta - PRI_lep_eta) ** 2)"
sql("higgs_physics_map", px.HIGGS + ", " + scaled("m", "higgs", {"DER_mass": "DER_mass", "DER_mass__log1p": "ln(1 + DER_mass)", "DER_mass_missing": "CASE WHEN DER_mass IS NULL THEN 1.0::DOUBLE ELSE 0 END", "PRI_tau_phi__sin": "sin(PRI_tau_phi)", "tau_lep__dr": _DR}), "SELECT * FROM m")
_TSQ = ", ".join(f"quantile_cont({f}, 0.1) FILTER (isfinite({f})) AS {f}1, median({f}) FILTER (isfinite({f})) AS {f}5, quantile_cont({f}, 0.9) FILTER (isfinite({f})) AS {f}9" for f in "sz")
sql("track_scaler", _ODD_TRACKS + f", q AS (SELECT {_TSQ} FROM odd_tracks)", "SELECT jet, slot, " + ", ".join(f"CASE WHEN coalesce(isfinite({f}), false) THEN round(least(greatest(({f} - {f}5) / greatest({f}9 - {f}1, 1e-6), -10), 10), 6) + 0 ELSE 0 END AS {f}" for f in "sz") + " FROM odd_tracks, q")
sql("gates", px.JETS + ", x AS (SELECT source_row, eta * 2 AS x FROM jets)", "SELECT source_row, round(1 / (1 + exp(-x)), 6) AS open, round(least(greatest(1.2::DOUBLE / (1 + exp(-x / 0.5::DOUBLE)) - 0.1::DOUBLE, 0), 1), 6) + 0 AS gate, round(1 / (1 + exp(-(x - 0.5::DOUBLE * ln(0.1::DOUBLE / 1.1::DOUBLE)))), 6) AS expected FROM x".replace("AS open", 'AS "open"'))

# -- graph --------------------------------------------------------------------
sql("knn_edges", px.GRAPH, "SELECT src, dst, rank, round(d2, 6) AS d2 FROM knn")
sql("knn_by_pivots", px.GRAPH, "SELECT src, dst, rank, round(d2, 6) AS d2 FROM knn")
sql("distributed_modes", "", "SELECT k, true AS converged, true AS unit FROM range(1, 7) t(k)")
sql("self_tuning_graph", px.GRAPH, "SELECT src, dst, round(w, 6) AS w FROM edges")
sql("graph_degree", px.GRAPH, "SELECT round(min(degree), 6) AS least, round(median(degree), 6) AS middle, round(max(degree), 6) AS most, (SELECT count(*) FROM edges) AS nnz FROM vote")
sql("kernel_posterior", px.GRAPH, "SELECT id, round(degree, 6) AS degree, round(p1, 6) AS p1 FROM post")
sql("information_potential", px.GRAPH, "SELECT y, count(*) AS n, round(avg(j), 6) AS avg_j, round(avg(v), 6) AS avg_v, round(avg(degree), 6) AS avg_degree FROM pot JOIN points ON vec_id = id GROUP BY 1")
sql("query_affinity_posterior", px.POINTS + """, marks AS (SELECT * FROM points WHERE vec_id % 2 = 0), asked AS (SELECT * FROM points WHERE vec_id % 2 = 1),
pl AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding, b.embedding) ** 2 AS d2 FROM marks a JOIN marks b ON a.vec_id <> b.vec_id),
sl AS (SELECT src AS id, sqrt(d2) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 12), dst) AS r FROM pl) WHERE r = 4),
pq AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding, b.embedding) ** 2 AS d2 FROM asked a, marks b),
kq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d2, 12), dst) AS r FROM pq) WHERE r <= 8),
sq AS (SELECT src AS id, sqrt(d2) AS sigma FROM kq WHERE r = 4),
w AS (SELECT k.src, k.dst, exp(-k.d2 / greatest(a.sigma * b.sigma, 1e-12)) AS w FROM kq k JOIN sq a ON a.id = k.src JOIN sl b ON b.id = k.dst),
pr AS (SELECT avg(y) AS p1 FROM marks)""", "SELECT src AS id, round(sum(w), 6) AS degree, round((sum(w * y) + any_value(p1)) / (sum(w) + 1), 6) AS p1 FROM w JOIN marks ON vec_id = dst, pr GROUP BY 1")
sql("log_odds_field", px.GRAPH, "SELECT id, round(ln(p1 / prior1) - ln((1 - p1) / (1 - prior1)), 6) + 0 AS field FROM pot")
sql("neighbour_ranks", px.GRAPH, "SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM edges")
sql("dense_affinities", px.POINTS + """, marks AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM points WHERE vec_id % 2 = 0), asked AS (SELECT * FROM points WHERE vec_id % 2 = 1),
pl AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding, b.embedding) ** 2 AS d2 FROM marks a JOIN marks b ON a.vec_id <> b.vec_id),
sl AS (SELECT src AS id, sqrt((list_sort(list(d2)))[4]) AS sigma FROM pl GROUP BY 1),
pq AS (SELECT a.vec_id AS src, b.vec_id AS dst, b.place, list_distance(a.embedding, b.embedding) ** 2 AS d2 FROM asked a, marks b),
sq AS (SELECT src AS id, sqrt((list_sort(list(d2)))[4]) AS sigma FROM pq GROUP BY 1),
w AS (SELECT k.src, k.place, exp(-k.d2 / greatest(a.sigma * b.sigma, 1e-12)) AS w FROM pq k JOIN sq a ON a.id = k.src JOIN sl b ON b.id = k.dst)""", "SELECT src, count(*) AS n, round(sum(w), 6) AS total, round(max(w), 6) AS most, round(sum(w * (place % 7)), 6) AS placed FROM w GROUP BY 1")
sql("laplacian_entries", px.LAPLACIAN, "SELECT src, dst, round(value, 6) AS value FROM lap")
_H = px.LAPLACIAN + ", h AS (SELECT src, dst, sum(value) AS value FROM (SELECT * FROM lap UNION ALL SELECT id, id, 0.5 * v FROM pot) GROUP BY 1, 2)"
sql("operator_entries", _H, "SELECT src, dst, round(value, 6) AS value FROM h")
sql("rayleigh_quotient", _H, "SELECT round(sum(h.value * cos(h.src * 0.3::DOUBLE) * cos(h.dst * 0.3::DOUBLE)) / (SELECT sum(cos(id * 0.3::DOUBLE) ** 2) FROM pot), 6) AS rayleigh FROM h")
_EXT = px.GRAPH + ", " + px.CLOSED + """, mean AS (SELECT e.src AS id, m.k, sum(e.w * m.phi) / sum(e.w) AS s FROM edges e JOIN modes m ON m.id = e.dst GROUP BY 1, 2),
ext AS (SELECT mean.id, mean.k, s, 1 + v - epsilon AS den FROM mean JOIN pot USING (id) JOIN eigen ON eigen.k = mean.k),
ok AS (SELECT k, min(abs(den)) >= 1e-6 AS stable FROM ext GROUP BY 1)"""
sql("inductive_extension", _EXT, "SELECT id, k, round(s / CASE WHEN abs(den) >= 1e-6 THEN den WHEN den < 0 THEN -1e-6 ELSE 1e-6 END, 6) AS phi, stable FROM ext JOIN ok USING (k)")
sql("stable_prefix", _EXT, "SELECT (coalesce(min(k) FILTER (NOT (stable AND k <> 5)), max(k) + 1) - 1)::INT AS prefix FROM ok")
_EXT4 = _EXT.replace("1 + v - epsilon AS den", "1 + CASE WHEN mean.id = 7 THEN 0.4::DOUBLE - 1 ELSE v END - epsilon AS den")
sql("extend_stable", _EXT4, "SELECT id, k, round(s / den, 6) AS phi FROM ext WHERE k < (SELECT coalesce(min(k) FILTER (NOT stable), 100) FROM ok)")
sql("occupations", px.CLOSED, "SELECT id, (k - 1)::INT AS place, round(a * a, 6) AS n FROM state")
sql("orbital_state", px.CLOSED, "SELECT id, k, round(phi / sqrt(sum(phi * phi) OVER (PARTITION BY id) + 1e-12), 6) AS a FROM modes WHERE k IN (1, 3, 4)")
_BLOCKS = px.CLOSED + ", gap AS (SELECT *, epsilon - lag(epsilon) OVER (ORDER BY epsilon, k) AS g, 100 * sqrt(2.220446049250313e-16) * greatest(1, max(abs(epsilon)) OVER ()) AS tol FROM eigen), blocks AS (SELECT k, epsilon, sum(CASE WHEN g > tol THEN 1 ELSE 0 END) OVER (ORDER BY epsilon, k)::BIGINT AS block FROM gap)"
sql("spectral_blocks", "c AS (SELECT c_nationkey, round(avg(c_acctbal), -2) AS epsilon FROM customer GROUP BY 1), eigen AS (SELECT row_number() OVER (ORDER BY epsilon, c_nationkey) AS k, epsilon FROM c), gap AS (" + _BLOCKS.split("gap AS (")[1], "SELECT * FROM blocks")
_SHARES = _BLOCKS + """, field AS (SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END + cos(vec_id * 0.2::DOUBLE) AS g, (1 + vec_id % 3)::DOUBLE AS degree FROM embeddings),
centre AS (SELECT sum(degree * g) / sum(degree) AS m FROM field),
proj AS (SELECT k, sum(degree * phi * (g - m)) / sqrt(sum(degree * phi * phi)) AS c FROM modes JOIN field USING (id), centre GROUP BY 1),
pw AS (SELECT k, block, c, avg(c * c) OVER (PARTITION BY block) AS p FROM proj JOIN blocks USING (k)),
shares AS (SELECT k, block, c, p / sum(p) OVER () AS q FROM pw)"""
sql("field_projection", _SHARES, "SELECT k, block, round(c, 6) AS c, round(q, 6) AS q FROM shares")
sql("participation_rank", _SHARES, "SELECT round(1 / sum(q * q), 6) AS participation, round(exp(-sum(q * ln(q))), 6) AS entropy FROM shares")
sql("prefix_select", _SHARES + ", need AS (SELECT greatest(2, ceil((SELECT 1 / sum(q * q) FROM shares)), min(k) FILTER (run >= 0.9 - 1e-12)) AS raw FROM (SELECT k, sum(q) OVER (ORDER BY k) AS run FROM shares))", "SELECT raw::INT AS raw, (SELECT max(k) FROM shares WHERE block = (SELECT block FROM shares WHERE k = raw))::INT AS selected FROM need")


def draws(name: str, replicates: int, size: str, among: str, seed: int) -> str:
    """CTEs that give ``name``: (replicate, r, w), how often rank r is drawn with replacement."""
    source = f"{name}_t AS (SELECT a.r AS replicate, b.t FROM range(0, {replicates}) a(r), (SELECT unnest(range(0, ({size})::BIGINT)) AS t) b)"
    return source + ", " + px.splitmix(f"{name}_t", "replicate * 1099511627776 + t", seed, f"{name}_h") + f", {name} AS (SELECT replicate::INT AS replicate, (h % ({among})::BIGINT::UBIGINT)::BIGINT + 1 AS r, count(*) AS w FROM {name}_h GROUP BY 1, 2)"


_PB = _BLOCKS + """, field AS (SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END + cos(vec_id * 0.2::DOUBLE) AS g, (1 + vec_id % 3)::DOUBLE AS degree, 1 AS one FROM embeddings), """ + ranked("rk", "field", 50, "id", "one") + ", " + draws("dw", 6, "SELECT count(*) FROM field", "SELECT count(*) FROM field", 51) + """,
drawn AS (SELECT replicate, id, g, degree * w AS d FROM rk JOIN dw USING (r)), centre AS (SELECT replicate, sum(d * g) / sum(d) AS m FROM drawn GROUP BY 1),
proj AS (SELECT replicate, k, sum(d * phi * (g - m)) / sqrt(sum(d * phi * phi)) AS c FROM drawn JOIN centre USING (replicate) JOIN modes USING (id) GROUP BY 1, 2),
pw AS (SELECT replicate, k, block, avg(c * c) OVER (PARTITION BY replicate, block) AS p FROM proj JOIN blocks USING (k)),
sh AS (SELECT replicate, k, block, p / sum(p) OVER (PARTITION BY replicate) AS q FROM pw), cu AS (SELECT *, sum(q) OVER (PARTITION BY replicate ORDER BY k) AS run FROM sh),
raw AS (SELECT replicate, least(max(k), greatest(2, ceil(1 / sum(q * q)), coalesce(min(k) FILTER (run >= 0.9 - 1e-12), max(k)))) AS raw FROM cu GROUP BY 1),
sel AS (SELECT replicate, (SELECT max(c.k) FROM cu c WHERE c.replicate = raw.replicate AND c.block = (SELECT x.block FROM cu x WHERE x.replicate = raw.replicate AND x.k = raw.raw)) AS selected FROM raw)"""
sql("prefix_bootstrap", _PB, "SELECT replicate, selected::INT AS selected FROM sel")
sql("prefix_record", _PB + ", per AS (SELECT selected, count(*) AS n FROM sel GROUP BY 1)", "SELECT (SELECT count(*) FROM sel) AS repetitions, (SELECT selected FROM per ORDER BY n DESC, selected LIMIT 1)::INT AS mode, round((SELECT max(n) FROM per) / (SELECT count(*) FROM sel), 6) AS mode_fraction, round((SELECT avg((selected = 4)::INT) FROM sel), 6) AS exact_fraction, (SELECT median(selected) FROM sel) AS median, (SELECT min(selected) FROM sel)::INT AS least, (SELECT max(selected) FROM sel)::INT AS most")
sql("mode_records", _SHARES, "SELECT k, epsilon, block, round(c, 6) AS c, round(c * c, 6) AS power, round(q, 6) AS q, round(sum(q) OVER (ORDER BY k), 6) AS cumulative, k <= 4 AS selected FROM shares JOIN eigen USING (k)")
sql("class_scatter", px.CLOSED + ", l AS (SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings)", "SELECT y, a.k AS i, b.k AS j, round(avg(a.a * b.a), 6) AS e FROM state a JOIN state b USING (id) JOIN l USING (id) GROUP BY 1, 2, 3")
_GRAD = _BLOCKS + ", ma AS (SELECT s.id, m.i AS k, sum(m.m * s.a) AS ma FROM state s JOIN meas m ON m.j = s.k GROUP BY 1, 2), g0 AS (SELECT id, k, a, ma, sum(a * ma) OVER (PARTITION BY id) AS p FROM state JOIN ma USING (id, k)), grad AS (SELECT id, k, p, ln(least(greatest(p, 1e-12), 1 - 1e-12) * 0.6::DOUBLE / ((1 - least(greatest(p, 1e-12), 1 - 1e-12)) * 0.4::DOUBLE)) * 2 * a * (ma - p * a) AS grad FROM g0)"
sql("gate_gradient", _GRAD, "SELECT id, k, round(p, 6) AS p, round(grad, 6) AS grad FROM grad")
_BS = _GRAD + ", per AS (SELECT id, block, sum(grad) AS g FROM grad JOIN blocks USING (k) GROUP BY 1, 2), bs AS (SELECT b.block, b.first, b.size, s.score FROM (SELECT block, min(k) AS first, count(*) AS size FROM blocks GROUP BY 1) b JOIN (SELECT block, avg(g * g) AS score FROM per GROUP BY 1) s USING (block))"
sql("block_scores", _BS, 'SELECT block, "first"::INT AS "first", size, round(score, 6) AS score FROM bs')
sql("greedy_select", _BS + ', r AS (SELECT *, score / sum(score) OVER () AS q, row_number() OVER (ORDER BY score DESC, "first") AS rank FROM bs), s AS (SELECT *, sum(q) OVER (ORDER BY rank) AS mass, sum(size) OVER (ORDER BY rank)::BIGINT AS modes, 1 / sum(q * q) OVER () AS p FROM r), e AS (SELECT coalesce(min(rank) FILTER (mass >= 0.8 - 1e-12 AND rank >= ceil(p) AND modes >= 2), max(rank)) AS last FROM s)', 'SELECT block, "first"::INT AS "first", size, round(score, 6) AS score, rank, round(mass, 6) AS mass, modes, rank <= last AS selected FROM s, e')
sql("ranked_subset", _BS + ', r AS (SELECT block, "first", size, sum(size) OVER (ORDER BY score / size DESC, "first") AS modes FROM bs)', 'SELECT block, "first"::INT AS "first", size, modes::BIGINT AS modes FROM r WHERE modes - size < 3')
_GREEDY = _BS + ', r AS (SELECT *, score / sum(score) OVER () AS q, row_number() OVER (ORDER BY score DESC, "first") AS rank FROM bs), s AS (SELECT *, sum(q) OVER (ORDER BY rank) AS mass, sum(size) OVER (ORDER BY rank)::BIGINT AS modes, 1 / sum(q * q) OVER () AS p FROM r), e AS (SELECT coalesce(min(rank) FILTER (mass >= 0.8 - 1e-12 AND rank >= ceil(p) AND modes >= 2), max(rank)) AS last FROM s)'
sql("gated_records", _GREEDY, "SELECT k, epsilon, block, round(score / size, 6) AS score, round(q / size, 6) AS weight, rank <= last AS selected, row_number() OVER (ORDER BY q / size DESC, k) AS rank FROM s JOIN blocks USING (block), e")
sql("gated_inclusion", _BS + ", ids AS (SELECT DISTINCT id, 1 AS one FROM per), " + ranked("rk", "ids", 60, "id", "one") + ", " + draws("dw", 6, "SELECT count(*) FROM ids", "SELECT count(*) FROM ids", 61) + ', sc AS (SELECT replicate, block, sum(w * g * g) / sum(w) AS score FROM per JOIN rk USING (id) JOIN dw USING (r) GROUP BY 1, 2), r AS (SELECT replicate, block, size, score / sum(score) OVER (PARTITION BY replicate) AS q, row_number() OVER (PARTITION BY replicate ORDER BY sc.score DESC, "first") AS rank FROM sc JOIN (SELECT block, "first", size FROM bs) USING (block)), s AS (SELECT *, sum(q) OVER (PARTITION BY replicate ORDER BY rank) AS mass, sum(size) OVER (PARTITION BY replicate ORDER BY rank) AS modes, 1 / sum(q * q) OVER (PARTITION BY replicate) AS p FROM r), e AS (SELECT replicate, coalesce(min(rank) FILTER (mass >= 0.8 - 1e-12 AND rank >= ceil(p) AND modes >= 2), max(rank)) AS last FROM s GROUP BY 1)', "SELECT k, round(count(*) / 6, 6) AS frequency FROM s JOIN e USING (replicate) JOIN blocks USING (block) WHERE rank <= last GROUP BY 1")
_M0 = "(CASE WHEN m.i = m.j THEN 1 ELSE 0 END - m.m / 3)"
sql("screening_measurement", px.CLOSED + """, a AS (SELECT id, phi, k, phi / sqrt(sum(phi * phi) OVER (PARTITION BY id) + 1e-12) AS a FROM modes WHERE k IN (1, 3)),
v AS (SELECT id, max(a) FILTER (k = 1) AS a1, max(a) FILTER (k = 3) AS a2 FROM a GROUP BY 1),
e AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, avg(a1 * a1) + 0.0005::DOUBLE AS e11, avg(a1 * a2) AS e12, avg(a2 * a2) + 0.0005::DOUBLE AS e22 FROM v JOIN embeddings ON vec_id = id GROUP BY 1),
s AS (SELECT sum(e11) AS p, sum(e12) AS q, sum(e22) AS r FROM e), d AS (SELECT *, sqrt(p * r - q * q) AS d FROM s),
t AS (SELECT (r + d) / (d * n) AS t11, -q / (d * n) AS t12, (p + d) / (d * n) AS t22 FROM (SELECT *, sqrt(p + r + 2 * d) AS n FROM d)),
m AS (SELECT t11 * t11 * e11 + 2 * t11 * t12 * e12 + t12 * t12 * e22 AS m11, t11 * t12 * e11 + (t11 * t22 + t12 * t12) * e12 + t12 * t22 * e22 AS m12, t12 * t12 * e11 + 2 * t12 * t22 * e12 + t22 * t22 * e22 AS m22 FROM e, t WHERE y = 1)""", "SELECT 1 AS i, 1 AS j, round(m11, 6) AS m FROM m UNION ALL SELECT 1, 2, round(m12, 6) FROM m UNION ALL SELECT 2, 1, round(m12, 6) FROM m UNION ALL SELECT 2, 2, round(m22, 6) FROM m")
sql("probability_decomposition", px.CLOSED + f", t AS (SELECT a.id, a.k AS i, b.k AS j, a.a * m.m * b.a AS v1, a.a * {_M0} * b.a AS v0 FROM state a JOIN state b USING (id) JOIN meas m ON m.i = a.k AND m.j = b.k), g AS (SELECT id, sum(v1) AS p1, sum(v0) AS p0, sum(v1) FILTER (i = j) AS d1, sum(v0) FILTER (i = j) AS d0 FROM t GROUP BY 1)", 'SELECT id, round(p1 / greatest(p0 + p1, 1e-12), 6) AS p, round(d1 / greatest(p0 + p1, 1e-12), 6) AS diagonal, round(d1 / greatest(d0 + d1, 1e-12), 6) AS diagonal_only, round((p1 - d1) / greatest(p0 + p1, 1e-12), 6) AS "cross" FROM g')
sql("psd_probability", px.CLOSED + ", t AS (SELECT a.id, a.k AS i, b.k AS j, a.a * m.m * b.a AS v FROM state a JOIN state b USING (id) JOIN meas m ON m.i = a.k AND m.j = b.k)", "SELECT id, round(sum(v), 6) AS p, round(coalesce(sum(v) FILTER (i = j), 0), 6) AS diagonal, round(sum(v) - coalesce(sum(v) FILTER (i = j), 0), 6) AS \"cross\" FROM t GROUP BY 1")

# -- evaluation ---------------------------------------------------------------


def auc(by: str, source: str = "scores", w: str = "1") -> str:
    return f"""cnt AS (SELECT {by}, score, sum({w} * y) AS p, sum({w} * (1 - y)) AS n FROM {source} GROUP BY ALL),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt),
auc AS (SELECT {by}, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM run GROUP BY ALL)"""


sql("roc_auc", px.SCORES + ", " + auc("method"), "SELECT method, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
_DESC = px.SCORES + ", cnt AS (SELECT method, score, sum(y) AS p, sum(1 - y) AS n FROM scores GROUP BY 1, 2), run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY method) AS tot_p, sum(n) OVER (PARTITION BY method) AS tot_n FROM cnt WINDOW w AS (PARTITION BY method ORDER BY score DESC))"
_AP = "sum(p * tp / (tp + fp)) / sum(p)"
sql("average_precision", _DESC, f"SELECT method, round({_AP}, 6) AS average_precision FROM run GROUP BY 1")
_ROC = _DESC + ", roc AS (SELECT method, score AS threshold, tp, fp, tot_p, tot_n FROM run UNION ALL SELECT DISTINCT method, NULL, 0, 0, tot_p, tot_n FROM run)"
sql("roc_corners", _DESC + """, c AS (SELECT *, lag(tp) OVER w IS NULL AS first, tp - coalesce(lag(tp) OVER w, 0) AS p0, fp - coalesce(lag(fp) OVER w, 0) AS n0, lead(tp) OVER w - tp AS p1, lead(fp) OVER w - fp AS n1 FROM run WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
k AS (SELECT method, score AS threshold, tp, fp, tot_p, tot_n FROM c WHERE first OR p1 IS NULL OR p0 <> p1 OR n0 <> n1 UNION ALL SELECT DISTINCT method, NULL, 0, 0, tot_p, tot_n FROM run)""", "SELECT method, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / tot_p, 6) AS tpr, round(fp / tot_n, 6) AS fpr FROM k")
sql("roc_table", _ROC, "SELECT method, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / tot_p, 6) AS tpr, round(fp / tot_n, 6) AS fpr, CASE WHEN fp > 0 THEN round(1 / (fp / tot_n), 6) END AS rejection, fp = 0 AS censored FROM roc")
_EFF = (0.65, 0.7, 0.77, 0.85, 0.9)


def points(by: str, source: str, thresholds: str) -> str:
    return f"""thr AS ({thresholds}), wp AS (SELECT {by}, efficiency, threshold, sum(y)::BIGINT AS n_signal, sum(1 - y)::BIGINT AS n_background,
coalesce(sum(y) FILTER (score >= threshold), 0)::BIGINT AS selected, coalesce(sum(1 - y) FILTER (score >= threshold), 0)::BIGINT AS mistags FROM {source} JOIN thr USING (method) GROUP BY ALL)"""


_THR = " UNION ALL ".join(f"SELECT method, {e}::DOUBLE AS efficiency, quantile_cont(score, {1 - e}) AS threshold FROM scores WHERE y = 1 GROUP BY 1" for e in _EFF)
_WP = px.SCORES + ", " + points("method", "scores", _THR)
sql("working_points", _WP, "SELECT method, efficiency, round(threshold, 6) AS threshold, n_signal, n_background, selected, mistags, round(selected / n_signal, 6) AS signal_efficiency, round(mistags / n_background, 6) AS mistag_rate, CASE WHEN mistags > 0 THEN round(n_background / mistags, 6) END AS rejection, mistags = 0 AS censored FROM wp")
sql("efficiency_pivot", _WP, "SELECT method, " + ", ".join(f"round(max(CASE WHEN mistags > 0 THEN n_background / mistags END) FILTER (efficiency = {e}), 6) AS rejection_{round(e * 100)}" for e in _EFF) + " FROM wp GROUP BY 1")
_PM = "prob AS (SELECT method, avg(-(y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) AS log_loss, avg((score - y) ** 2) AS brier, " + ", ".join(f"{count(f'{h} AND y = {y}')} AS {n}" for n, h, y in (("tp", "score >= 0.5", 1), ("tn", "score < 0.5", 0), ("fp", "score >= 0.5", 0), ("fn", "score < 0.5", 1))) + " FROM scores GROUP BY 1), pm AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM prob)"
_PMC = "log_loss brier accuracy balanced_accuracy mcc".split()
sql("probability_metrics", px.SCORES + ", " + _PM, "SELECT method, tp, tn, fp, fn, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PMC) + " FROM pm")
sql("classification_summary", _DESC + ", ap AS (SELECT method, " + _AP + " AS average_precision FROM run GROUP BY 1), " + auc("method").replace("cnt AS", "cnt2 AS").replace("FROM cnt)", "FROM cnt2)").replace("run AS", "run2 AS").replace("FROM run GROUP", "FROM run2 GROUP") + ", " + _PM, "SELECT method, round(auc, 6) AS auc, round(average_precision, 6) AS average_precision, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PMC) + " FROM auc JOIN ap USING (method) JOIN pm USING (method)")


def _case(x: str, edges: list) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a}" + (f" AND {x} < {b}" if b else "") + f" THEN {k}" for k, (a, b) in enumerate(edges)) + " END"


_SL = px.SCORES + ", sliced AS (SELECT * FROM (SELECT *, 'pt' AS axis, " + _case("pt / 1000", [(20, 40), (40, 70), (70, 120), (120, 250), (250, None)]) + " AS slice FROM scores UNION ALL SELECT *, 'abs_eta' AS axis, " + _case("abs(eta)", [(0, 0.6), (0.6, 1.2), (1.2, 1.8), (1.8, 2.5)]) + " AS slice FROM scores) WHERE slice IS NOT NULL)"
sql("slice_auc", _SL + ", " + auc("axis, slice, method", "sliced"), "SELECT axis, slice, method, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
sql("slice_efficiency", _SL + ", " + points("axis, slice, method", "sliced", "SELECT method, 0.7::DOUBLE AS efficiency, quantile_cont(score, 0.3) AS threshold FROM scores WHERE y = 1 GROUP BY 1"), "SELECT axis, slice, method, selected, mistags, round(selected / nullif(n_signal, 0), 6) AS signal_efficiency, round(mistags / nullif(n_background, 0), 6) AS mistag_rate FROM wp")
sql("score_validity", px.SCORES, f"SELECT method, count(*) AS n, {count('source_row % 23 = 0 OR source_row % 29 = 0 OR source_row % 31 = 0 OR source_row % 37 = 0')} AS n_invalid FROM scores GROUP BY 1")
sql("visible_points", _ROC, "SELECT method, count(*) AS n, round(max(1 / (fp / tot_n)), 6) AS most FROM roc WHERE tp / tot_p >= 0.45 AND fp > 0 GROUP BY 1")
_RK = px.TRACKS + ", rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("s", "z", "u", "v", "hits")) + " FROM tracks)"
_RHO = _RK + ", rho AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS rho FROM rk" for a in "sz" for b in ("u", "v", "hits")) + ")"
sql("enough_points", px.JETS + ", n AS (SELECT count(*) AS n FROM jets), k AS (SELECT source_row, event_number, row_number() OVER (ORDER BY source_row) - 1 AS k FROM jets)", "SELECT source_row, event_number FROM k, n WHERE n <= 400 OR k = round(round(k / ((n - 1) / 399)) * ((n - 1) / 399))")
sql("aligned_comparison", px.SCORES + ", " + _WIDE, "SELECT * FROM wide")
sql("aligned_states", px.BL, "SELECT source_row, event_number, y, y - 0.5::DOUBLE AS orbital_1, source_row % 7 / 8 AS orbital_2, source_row % 5 / 4 AS orbital_3 FROM bl")
sql("feature_join", px.JETS + ", " + px.TRACKS, "SELECT source_row, pt, round(max(s), 6) AS most FROM jets LEFT JOIN tracks ON jet = source_row GROUP BY 1, 2")
sql("spearman_matrix", _RHO, 'SELECT "left", "right", round(rho, 6) AS rho FROM rho')
sql("best_feature_per_group", _RHO, 'SELECT "left", "right", round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY abs(rho) DESC, "right") AS k FROM rho) WHERE k = 1')
for _n, _s in (("class_summary", "stddev_samp"), ("class_summary_population", "stddev_pop")):
    sql(_n, px.SCORES, f"SELECT method, y, count(*) AS n, round(avg(score), 6) AS mean, round({_s}(score), 6) AS std, round(quantile_cont(score, 0.16), 6) AS q16, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.84), 6) AS q84 FROM scores GROUP BY 1, 2")
sql("histogram_1d", px.TRACKS + ", b AS (SELECT hits, least(floor((s + 3) / (8::DOUBLE / 44)), 43)::INT AS bin FROM tracks WHERE s BETWEEN -3 AND 5)", "SELECT hits, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY hits) * (8::DOUBLE / 44)), 6) AS density FROM b GROUP BY 1, 2")
_GRID = px.TRACKS + ", grid AS (SELECT least(floor((s + 3) / (8::DOUBLE / 12)), 11)::INT AS bx, least(floor((z + 3) / (6::DOUBLE / 12)), 11)::INT AS \"by\", count(*) AS n FROM tracks WHERE s BETWEEN -3 AND 5 AND z BETWEEN -3 AND 3 GROUP BY 1, 2)"
sql("histogram_2d", _GRID, "SELECT * FROM grid")
_KER = "ker AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-3, 4) t(e)) AS w FROM range(-3, 4) t(d)), cell AS (SELECT k, least(greatest(k + d, 0), 11) AS i, w FROM range(0, 12) t(k), ker)"
sql("smoothed_grid", _GRID + ", " + _KER + ', sx AS (SELECT k AS bx, "by", sum(n * w) AS n FROM grid JOIN cell ON i = bx GROUP BY 1, 2), sy AS (SELECT bx, k AS "by", sum(n * w) AS n FROM sx JOIN cell ON i = "by" GROUP BY 1, 2)', 'SELECT bx::INT AS bx, "by"::INT AS "by", round(n, 6) AS n FROM sy')
sql("enclosed_mass", _GRID, 'SELECT max(n) AS level FROM (SELECT n, sum(n) OVER (ORDER BY n DESC, bx, "by") AS run, sum(n) OVER () AS total FROM grid) WHERE run >= 0.68 * total')
sql("hard_negatives", px.SCORES, "SELECT source_row, y, place FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 1 THEN score ELSE -score END, source_row) AS place FROM scores WHERE method = 'a') WHERE place <= 50")

# -- bootstrap ----------------------------------------------------------------
_BOOT = px.SCORES + ", ev AS (SELECT DISTINCT event_number, 1 AS one FROM bl), " + ranked("rk", "ev", 29, "event_number", "one") + ", " + draws("dw", 8, "SELECT count(*) FROM ev", "SELECT count(*) FROM ev", 31) + ", drawn AS (SELECT s.*, replicate, w FROM scores s JOIN rk USING (event_number) JOIN dw USING (r)), " + auc("replicate, method", "drawn", "w")
sql("metric_intervals", _BOOT.replace("auc AS (SELECT replicate", "boot AS (SELECT replicate") + ", " + auc("method").replace("cnt AS", "cnt3 AS").replace("FROM cnt)", "FROM cnt3)").replace("run AS", "run3 AS").replace("FROM run GROUP", "FROM run3 GROUP") + ", iv AS (SELECT method, quantile_cont(auc, 0.025) AS lower, quantile_cont(auc, 0.975) AS upper, stddev_samp(auc) AS se FROM boot WHERE method = 'a' GROUP BY 1)", 'SELECT method, round(auc, 6) AS auc, n_pos, n_neg, round("lower", 6) AS "lower", round("upper", 6) AS "upper", round(se, 6) AS se FROM auc LEFT JOIN iv USING (method)')
sql("event_bootstrap_auc", _BOOT, "SELECT replicate, method, round(auc, 6) AS auc FROM auc")
sql("bootstrap_summary", _BOOT, "SELECT method, round(stddev_samp(auc), 6) AS se, " + ", ".join(f"round(quantile_cont(auc, {q}), 6) AS {n}" for n, q in (("q16", 0.16), ("q84", 0.84), ("q025", 0.025), ("q975", 0.975))) + " FROM auc GROUP BY 1")
sql("paired_auc_difference", _BOOT + ", d AS (SELECT x.method, x.auc - b.auc AS d FROM auc x JOIN auc b ON b.replicate = x.replicate AND b.method = 'a' WHERE x.method <> 'a')", "SELECT method, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) AS p FROM d GROUP BY 1")

# -- selection ----------------------------------------------------------------
_ARMS = 'a0 AS (SELECT c_nationkey AS arm, round(avg(c_acctbal), 2) AS score, count(*) AS size FROM customer GROUP BY 1), arms AS (SELECT *, round(score - 100 * (arm % 4), 2) AS "lower", size % 4 AS k, arm % 3 AS bank FROM a0)'
sql("screen_topk", _ARMS, "SELECT arm, score, size FROM arms ORDER BY score DESC, size, arm LIMIT 5")
sql("arm_selection", _ARMS, 'SELECT arm, k, "lower" FROM arms ORDER BY k, "lower" DESC, arm LIMIT 1')
sql("one_percent_select", _ARMS, 'SELECT arm, "lower", score, size FROM arms WHERE "lower" >= 0.9::DOUBLE * (SELECT max("lower") FROM arms) ORDER BY size, score DESC, k, arm LIMIT 1')
sql("arm_dedup", _ARMS + ", c AS (SELECT *, array_to_string(list_filter([0, 1, 2, 3], lambda x: x <= k % 2 OR x = size % 2), ',') AS chosen FROM arms)", "SELECT bank, chosen, k, arm FROM (SELECT *, row_number() OVER (PARTITION BY bank, chosen ORDER BY k, arm) AS r FROM c) WHERE r = 1")

# -- more of the above --------------------------------------------------------
sql("physical_coordinates", px.TRACKS, "SELECT jet, round(max(abs(s)), 6) AS max_s, round(max(abs(z)), 6) AS max_z, count(*) AS n_tracks FROM tracks GROUP BY 1")
sql("track_dropout", px.TRACKS + ", " + px.splitmix("tracks", "jet * 1000 + slot - 1", 5, "hashed") + ", kept AS (SELECT jet, slot, h % 10000 < 7000 AS ok, bool_or(h % 10000 < 7000) OVER (PARTITION BY jet) AS any_ok FROM hashed)", "SELECT jet, slot FROM kept WHERE ok OR (NOT any_ok AND slot = 1)")
sql("event_bootstrap_metrics", _BOOT, "SELECT replicate, method, round(sum(w * -(y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) / sum(w), 6) AS log_loss, round(sum(w * ((score >= 0.5)::INT = y)::INT) / sum(w), 6) AS accuracy, round((sum(w) FILTER (y = 1 AND score >= 0.5) / sum(w) FILTER (y = 1) + sum(w) FILTER (y = 0 AND score < 0.5) / sum(w) FILTER (y = 0)) / 2, 6) AS balanced_accuracy FROM drawn GROUP BY 1, 2")
_LOSS = "sum(w * -(y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) / sum(w)"
_ACC = "sum(w * ((score >= 0.5)::INT = y)::INT) / sum(w)"
_BAL = "(sum(w) FILTER (y = 1 AND score >= 0.5) / sum(w) FILTER (y = 1) + sum(w) FILTER (y = 0 AND score < 0.5) / sum(w) FILTER (y = 0)) / 2"
_N = "SELECT {} FROM sizes"
_STRAT = px.SCORES + ", " + ranked("rk", "bl", 37) + ", c0 AS (SELECT sum(1 - y) AS n0, sum(y) AS n1, least(count(*), 4000) AS n, count(*) AS everything FROM bl), sizes AS (SELECT n0, n1, least(greatest(1, round_even(n * n0 / everything, 0)), n - 1)::BIGINT AS z, n - least(greatest(1, round_even(n * n0 / everything, 0)), n - 1)::BIGINT AS o FROM c0), " + draws("d0", 4, _N.format("z"), _N.format("n0"), 41) + ", " + draws("d1", 4, _N.format("o"), _N.format("n1"), 42) + ", dw AS (SELECT *, 0 AS y FROM d0 UNION ALL SELECT *, 1 AS y FROM d1), drawn AS (SELECT s.method, s.score, s.y, replicate, w FROM scores s JOIN (SELECT source_row, y, r FROM rk) USING (source_row, y) JOIN dw USING (r, y)), " + auc("replicate, method", "drawn", "w") + f", st AS (SELECT replicate, method, {_LOSS} AS log_loss, {_ACC} AS accuracy, {_BAL} AS balanced_accuracy FROM drawn GROUP BY 1, 2), both_ AS (SELECT replicate, method, auc, log_loss, accuracy, balanced_accuracy FROM auc JOIN st USING (replicate, method))"
_SM = ("auc", "log_loss", "accuracy", "balanced_accuracy")
sql("stratified_bootstrap_auc", _STRAT, "SELECT replicate, method, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SM) + " FROM both_")
sql("stratified_intervals", _STRAT, " UNION ALL ".join(f"SELECT method, '{c}' AS metric, round(quantile_cont({c}, 0.025), 9) AS \"lower\", round(quantile_cont({c}, 0.975), 9) AS \"upper\", round(stddev_samp({c}), 9) AS se FROM both_ GROUP BY 1" for c in _SM))
sql("rejection_ratio", _WP + ", r AS (SELECT method, efficiency, CASE WHEN mistags > 0 THEN n_background / mistags END AS rejection FROM wp)", "SELECT a.efficiency, round(b.rejection / a.rejection, 6) AS ratio FROM r a JOIN r b ON a.efficiency = b.efficiency AND a.method = 'a' AND b.method = 'b'")
_CHECK = ", ".join(f"w{w} AS (SELECT k, block, q / sum(q) OVER () AS q FROM shares WHERE k <= {w}), n{w} AS (SELECT greatest(2, ceil((SELECT 1 / sum(q * q) FROM w{w})), min(k) FILTER (run >= 0.9 - 1e-12)) AS raw FROM (SELECT k, sum(q) OVER (ORDER BY k) AS run FROM w{w}))" for w in (3, 4, 5, 6))
_ALL = " UNION ALL ".join(f"SELECT {w} AS width, (SELECT max(k) FROM w{w} WHERE block = (SELECT block FROM w{w} WHERE k = raw))::INT AS selected FROM n{w}" for w in (3, 4, 5, 6))
sql("checkpoint_stability", _SHARES + ", " + _CHECK + f", c AS ({_ALL})", "SELECT width, selected, selected >= width AS ceiling, coalesce(lag(selected) OVER (ORDER BY width) = selected, false) AND selected < width AS stable FROM c")
