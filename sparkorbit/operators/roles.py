"""Event-disjoint roles, balanced samples, group holdouts and their audits.

Random choices are ranks of a SplitMix64 hash, so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..functions.scalars import finite, splitmix64, unsigned_mod

#: The role of each event number modulo 10.
ROLES = {0: "base", 1: "base", 2: "base", 3: "base", 4: "base", 5: "base", 6: "operator", 7: "operator", 8: "dimension", 9: "test"}
#: Fiducial cuts in GeV.
PT_MIN, PT_MAX, ETA_MAX = 20.0, 250.0, 2.5
SAMPLE_BINS = 1 << 12


def mod10_role(event: Column) -> Column:
    m = F.pmod(event, F.lit(10))
    return F.when(m <= 5, "base").when(m <= 7, "operator").when(m == 8, "dimension").otherwise("test")


def fiducial(pt_gev: Column, eta: Column, label: Column, pilot: bool = False) -> Column:
    """Jets of the two flavours inside the fiducial volume, or anywhere in the pilot protocol.

    Null, NaN and infinite kinematics fail in both.
    """
    known = F.coalesce(finite(pt_gev) & finite(eta), F.lit(False))
    inside = known if pilot else known & (pt_gev > PT_MIN) & (pt_gev < PT_MAX) & (F.abs(eta) < ETA_MAX)
    return F.coalesce(inside & label.isin(0, 5), F.lit(False))


def fiducial_audit(df: DataFrame, pt_gev: Column, eta: Column, label: Column, pilot: bool = False) -> DataFrame:
    """Counts of rows, those of finite kinematics, known flavours and those that pass."""
    known = F.coalesce(finite(pt_gev) & finite(eta), F.lit(False))
    return df.agg(F.count("*").alias("n_rows"), F.sum(known.cast("long")).alias("n_finite"), F.sum(F.coalesce(label.isin(0, 5), F.lit(False)).cast("long")).alias("n_flavour"), F.sum(fiducial(pt_gev, eta, label, pilot).cast("long")).alias("n_pass"))


def split_bit(event: Column, seed: int = 0) -> Column:
    """Half of the events: the low bit of their hash."""
    return splitmix64(event, seed).bitwiseAND(F.lit(1)).cast("int")


def event_halves(df: DataFrame, event: str, seed: int = 0) -> DataFrame:
    """``df`` with ``half`` of its events, by hash; by every other event if the hash puts all in one half."""
    events = df.select(event).distinct().withColumn("half", split_bit(F.col(event), seed))
    row = events.agg(F.min("half").alias("a"), F.max("half").alias("b")).first()
    if row["a"] == row["b"]:
        events = running_sums(df.select(event).distinct().withColumn("_one", F.lit(1)), event, {"_k": "_one"}, inclusive=False)
        events = events.select(event, (F.col("_k") % 2).cast("int").alias("half"))
    return df.join(events, event)


def split_fraction(event: Column, fraction: float, seed: int = 0) -> Column:
    """Whether an event falls into this share of all, in steps of 1 / 10000."""
    return unsigned_mod(splitmix64(event, seed), 10_000) < int(round(fraction * 10_000))


def hash_rank(key: Column, seed: int = 0) -> Column:
    """A key's place in [0, 2^63) in the sampling order."""
    return F.shiftrightunsigned(splitmix64(key, seed), 1)


def ranked(df: DataFrame, key: str, by: list[str], seed: int = 0, most: Column | None = None) -> DataFrame:
    """``df`` with ``_r``, the rank from 1 of a row in its class by the hash of its key; of ``most`` rows a class, or all.

    Only the hash range that can hold them is ordered: counts of bins come first.
    """
    hashed = df.withColumn("_h", hash_rank(F.col(key), seed)).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 51))
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.withColumn("_before", before)
    bins = (bins if most is None else bins.where(F.col("_before") < most)).select(*by, "_b", "_before")
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    out = hashed.join(F.broadcast(bins), [*by, "_b"]).withColumn("_r", F.col("_before") + inner)  # at most 4096 bins of a class
    return (out if most is None else out.where(F.col("_r") <= most)).select(*df.columns, "_r")


def _of_class(n: dict, label: str) -> Column:
    out = F.lit(0)
    for c, k in n.items():
        out = F.when(F.col(label) == F.lit(c), F.lit(int(k))).otherwise(out)
    return out


def smallest(df: DataFrame, n: dict | int, key: str, by: list[str], seed: int = 0) -> DataFrame:
    """The ``n`` rows of the smallest hash in each class, or n[class] of a single class column."""
    return ranked(df, key, by, seed, _of_class(n, by[0]) if isinstance(n, dict) else F.lit(int(n))).drop("_r")


def class_counts(df: DataFrame, label: str = "y") -> dict[int, int]:
    """Rows of the classes 0 and 1."""
    held = {r[label]: r["n"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    return {0: held.get(0, 0), 1: held.get(1, 0)}


def proportional(size: int, counts: dict[int, int]) -> dict[int, int]:
    """``size`` shared by the classes as they share all rows, the part of class 1 rounded half up."""
    n = sum(counts.values())
    if not 0 < size <= n:
        raise ValueError(f"{size} of {n} rows were asked for")
    one = min(counts[1], max(size - counts[0], (2 * size * counts[1] + n) // (2 * n)))
    return {0: size - one, 1: one}


def proportional_sample(df: DataFrame, size: int, key: str, label: str = "y", seed: int = 0) -> DataFrame:
    """``size`` rows with the class shares of all rows; 0, or no fewer than there are, takes all."""
    counts = class_counts(df, label)
    if size <= 0 or size >= sum(counts.values()):
        return df
    return smallest(df, proportional(size, counts), key, [label], seed)


def random_split(df: DataFrame, fraction: float, key: str, label: str = "y", seed: int = 0) -> DataFrame:
    """``df`` with role ``test`` for this share of each class, else ``development``."""
    counts = class_counts(df, label)
    test = proportional(round(fraction * sum(counts.values())), counts)
    return ranked(df, key, [label], seed).withColumn("role", F.when(F.col("_r") <= _of_class(test, label), "test").otherwise("development")).drop("_r")


def fixed_roles(df: DataFrame, sizes: dict[str, int], key: str, label: str = "y", seed: int = 0) -> DataFrame:
    """Rows of disjoint roles of fixed sizes, each with the class shares of all rows."""
    if min(sizes.values()) <= 0:
        raise ValueError("every role has a positive size")
    left = class_counts(df, label)
    if sum(sizes.values()) > sum(left.values()):
        raise ValueError("the roles have more rows than there are")
    ends, role = {0: 0, 1: 0}, F.lit(None).cast("string")
    whole = dict(left)
    for name, size in sizes.items():
        share = proportional(size, whole)
        for c in (0, 1):  # a class that the roles before have used up gives to the other
            other = 1 - c
            short = max(0, ends[c] + share[c] - whole[c])
            share = {c: share[c] - short, other: share[other] + short}
        now = {c: ends[c] + share[c] for c in (0, 1)}
        role = F.when((F.col("_r") > _of_class(ends, label)) & (F.col("_r") <= _of_class(now, label)), name).otherwise(role)
        ends = now
    return ranked(df, key, [label], seed, _of_class(ends, label)).withColumn("role", role).where("role is not null").drop("_r")


def group_limit(df: DataFrame, size: int, group: str, label: str = "y", seed: int = 0) -> DataFrame:
    """All rows of about ``size`` / rows of the groups, with the class shares of the groups; 0 takes all rows."""
    n = df.count()
    if size <= 0 or size >= n:
        return df
    groups = df.groupBy(group).agg(F.min(label).alias(label))
    counts = class_counts(groups, label)
    have = sum(counts.values())
    want = min(max(round(have * size / n), 2), have - 1)
    return df.join(smallest(groups, proportional(want, counts), group, [label], seed).select(group), group, "left_semi")


def balanced_sample(df: DataFrame, size: int, key: str, label: str = "y", seed: int = 0) -> DataFrame:
    """``size`` rows, half of each class; 0 takes all of the smaller class. Odd sizes are refused."""
    if size % 2:
        raise ValueError("a balanced sample has an even size")
    half = size // 2
    least = min(class_counts(df, label).values())
    if half > least:
        raise ValueError(f"a class has only {least} rows")
    return smallest(df.where(F.col(label).isin(0, 1)), half or least, key, [label], seed)


def stratified_take(df: DataFrame, size: int, key: str, label: str = "y", seed: int = 0) -> DataFrame:
    """At most ``size`` rows, half of each class, topped up from the class that has more."""
    counts = class_counts(df, label)
    zero = min(counts[0], size // 2)
    one = min(counts[1], size - zero)
    zero = min(counts[0], size - one)
    return smallest(df, {0: zero, 1: one}, key, [label], seed)


def event_cap(df: DataFrame, event: str, most: int, seed: int = 1701) -> DataFrame:
    """All rows of at most ``most`` events, chosen without looking at labels."""
    events = df.select(event).distinct()
    kept = smallest(events.withColumn("_one", F.lit(1)), most, event, ["_one"], seed).select(event)
    return df.join(kept, event, "left_semi")


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """``df`` with a ``fold`` for each group: the groups of each label are dealt in hash order, one fold after the other.

    Groups of several labels, and fewer groups of a label than folds, are refused.
    """
    groups = df.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("_most"))
    row = groups.agg(F.max((F.col(label) != F.col("_most")).cast("int")).alias("mixed"), F.sum(F.col(label)).alias("one"), F.sum(1 - F.col(label)).alias("zero")).first()
    if row["mixed"]:
        raise ValueError("a group has several labels")
    if min(row["one"] or 0, row["zero"] or 0) < folds:
        raise ValueError(f"a class has fewer than {folds} groups")
    dealt = ranked(groups.drop("_most"), group, [label], seed).select(group, ((F.col("_r") - 1) % folds).cast("int").alias("fold"))
    return df.join(dealt, group)


def group_holdout(df: DataFrame, group: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """(fold, size_error, balance_error, best): the folds as holdouts, the best of smallest summed errors."""
    if not 0.05 <= fraction <= 0.5:
        raise ValueError("the share held out is between 0.05 and 0.5")
    folds = max(2, round(1 / fraction))
    dealt = group_folds(df, group, label, folds, seed)
    totals = df.agg(F.count("*").alias("_n"), F.avg(label).alias("_p"))
    per = dealt.groupBy("fold").agg(F.count("*").alias("n"), F.avg(label).alias("p")).crossJoin(F.broadcast(totals))
    per = per.select("fold", "n", F.abs(F.col("n") / F.col("_n") - fraction).alias("size_error"), F.abs(F.col("p") - F.col("_p")).alias("balance_error"))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("size_error") + F.col("balance_error"), 12), "fold"))
    return per.withColumn("best", rank == 1)


def tail_split(row: Column, n_rows: int, n_test: int = 500_000) -> Column:
    """The official split: the last rows are the test."""
    return F.when(row >= n_rows - n_test, "test").otherwise("development")


def role_audit(df: DataFrame, role: str = "role", row: str = "source_row", event: str = "event_number", label: str = "y") -> DataFrame:
    """Rows, events, class counts and an order-free digest of the rows of each role."""
    digest = F.sum(F.conv(F.substring(F.sha2(F.col(row).cast("string"), 256), 1, 8), 16, 10).cast("long"))
    return df.groupBy(role).agg(F.count("*").alias("n_rows"), F.countDistinct(event).alias("n_events"), F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"), digest.alias("digest"))


def role_overlaps(df: DataFrame, role: str = "role", event: str = "event_number") -> DataFrame:
    """(left, right, shared): events that two roles share."""
    one = df.select(F.col(role).alias("left"), event).distinct()
    two = one.withColumnRenamed("left", "right")
    return one.join(two, event).where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared"))


def partition_violations(df: DataFrame, row: str, n_rows: int) -> DataFrame:
    """One row: rows that several roles have, and rows that none has."""
    per = df.groupBy(row).agg(F.count("*").alias("n"))
    return per.agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated"), (F.lit(n_rows) - F.count("*")).alias("missing"))


def group_conflicts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups that carry more than one label."""
    return df.groupBy(group).agg(F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_rows")).where("n_labels > 1")


def group_audit(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups, rows in groups of several, and the largest group."""
    per = df.groupBy(group).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicated"), F.max("n").alias("largest"))


def missing_classes(df: DataFrame, role: str = "role", label: str = "y") -> DataFrame:
    """(role, n_classes): roles that lack one of the two classes."""
    return df.groupBy(role).agg(F.countDistinct(label).alias("n_classes")).where("n_classes < 2")


def split_violations(df: DataFrame, n_rows: int, residues: dict[str, set[int]], nested: dict[str, str] | None = None, role: str = "role", row: str = "source_row", event: str = "event_number", part: str | None = None) -> DataFrame:
    """One row of counts that are all 0 for a valid split of ``n_rows`` rows.

    Rows that are repeated, missing or negative; events that two roles share; rows
    whose event number modulo 10 is not one of the role's ``residues``; rows of a
    ``part`` outside the role in which it is ``nested``; events that two parts share.
    """
    own = F.lit(False)
    for name, held in residues.items():
        own = own | ((F.col(role) == name) & F.pmod(F.col(event), F.lit(10)).isin(*sorted(held)))
    checks = [partition_violations(df, row, n_rows)]
    counts = [F.sum((F.col(row) < 0).cast("long")).alias("negative"), F.sum((~F.coalesce(own, F.lit(False))).cast("long")).alias("wrong_residue")]
    if part is not None:
        home = F.create_map(*(F.lit(v) for pair in (nested or {}).items() for v in pair))
        inside = F.col(part).isNull() | (home[F.col(part)] == F.col(role))
        counts.append(F.sum((~F.coalesce(inside, F.lit(False))).cast("long")).alias("outside"))
    checks.append(df.agg(*counts))
    total = lambda d, name: d.agg(F.coalesce(F.sum("shared"), F.lit(0)).alias(name))
    checks.append(total(role_overlaps(df, role, event), "shared_events"))
    if part is not None:
        checks.append(total(role_overlaps(df.where(F.col(part).isNotNull()), part, event), "shared_part_events"))
    out = checks[0]
    for c in checks[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out
