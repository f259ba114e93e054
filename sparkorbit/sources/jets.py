"""The event-role scan: selection, balanced sample, roles and audit of jets, with or without their tracks.

Jets are a table (source_row, event_number, label_raw, pt, eta, ...) with an optional
nested column of tracks; a scan that leaves the tracks out never reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored
from ..operators import roles
from ..operators.tracks import known_flavours, summaries, track_batch
from .tables import SchemaError

#: Columns that no input may have, scores of other taggers and truth.
FORBIDDEN = ("GN2v01_pb", "GN2v01_pc", "GN2v01_pu", "GN2v01_ptau", "DL1dv01_pb", "DL1dv01_pc", "DL1dv01_pu", "HadronGhostTruthLabelID", "HadronConeExclTruthLabelID")


def check_inputs(columns: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> None:
    """Features without truth or other taggers' scores."""
    present = [c for c in columns if c in forbidden]
    if present:
        raise SchemaError(f"forbidden: {present}")


def jet_index(jets: DataFrame, sample: int = 0, max_events: int = 0, seed: int = 0, pilot: bool = False) -> tuple[DataFrame, dict]:
    """(source_row, event_number, y, role) of the selected jets, and the audit of the selection.

    Label-blind cap on events, fiducial volume, balanced sample (0: all of the smaller
    class), roles by event number modulo 10.  A role without both classes is refused.
    """
    slim = jets.select("source_row", "event_number", "label_raw", (F.col("pt") / 1000).alias("pt_gev"), "eta")
    if max_events:
        slim = roles.event_cap(slim, "event_number", max_events)
    cut = (F.col("pt_gev"), F.col("eta"), F.col("label_raw"))
    audit = roles.fiducial_audit(slim, *cut, pilot).first().asDict()
    kept = known_flavours(slim.where(roles.fiducial(*cut, pilot))).select("source_row", "event_number", "y")
    kept = roles.balanced_sample(kept, sample, "source_row", seed=seed)
    kept = stored(kept.withColumn("role", roles.mod10_role(F.col("event_number"))))
    lacking = roles.missing_classes(kept).collect()  # four roles at most
    if lacking:
        raise ValueError(f"roles without both classes: {[r['role'] for r in lacking]}")
    return kept, audit | {"n_sample": kept.count()}


def jet_summaries(jets: DataFrame, index: DataFrame, tracks: DataFrame, fields: list[str]) -> DataFrame:
    """The index with summaries of the tracks' fields, which are read for the selected jets alone."""
    check_inputs(fields)
    mine = tracks.join(index.select(F.col("source_row").alias("jet")), "jet", "left_semi")
    return index.join(summaries(index.select(F.col("source_row").alias("jet")), mine, "jet", fields).withColumnRenamed("jet", "source_row"), "source_row")


def jet_batches(jets: DataFrame, index: DataFrame, fields: list[str], significance: str, k: int) -> DataFrame:
    """The index with ``x``, the k leading tracks, and ``context`` of every selected jet (columns pt, eta, tracks)."""
    check_inputs([*fields, significance])
    rows = jets.select("source_row", "pt", "eta", "tracks").join(index, "source_row")
    return track_batch(rows, F.col("tracks"), fields, significance, k).select(*index.columns, "x", "context")


def labels_and_events(jets: DataFrame, index: DataFrame) -> DataFrame:
    """(source_row, event_number, y) of the indexed jets, read again and checked: flavours 0 and 5, the index's labels."""
    rows = known_flavours(jets.select("source_row", "event_number", "label_raw").join(index.select("source_row", F.col("y").alias("_y")), "source_row"))
    refused = F.raise_error(F.lit("a label differs from the index")).cast("int")
    return rows.select("source_row", "event_number", F.when(F.col("y") == F.col("_y"), F.col("y")).otherwise(refused).alias("y"))
