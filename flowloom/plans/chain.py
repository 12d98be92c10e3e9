"""The whole chain: packets → flows → snapshots → host windows → features → verdicts → alerts.

Every stage is a plain function of DataFrames. ``Stages`` strings them together over one input and
writes the stages that several later ones read (flows, ticks, snapshots, points) to the checkpoint
folder once, which also keeps a lost executor from recomputing the chain.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.fixed import IDLE_US, SECOND_US
from flowloom.operators import alerts, evaluation, evidence, features, flows, hostwindows, packets
from flowloom.operators.flows import FLOW
from flowloom.session import checkpoint

RULE_THRESHOLDS = {"BENIGN": 0.5, "DDOS": 0.45, "RECON": 0.55, "BOT_OR_C2_LIKE": 0.6}
RULE_MODEL = "rules-v1"


def rule_scores() -> tuple[Column, Column]:
    """A fixed rule table in place of a trained model: (raw, calibrated) class probabilities.

    Whole-number weights from window counts, so that every engine gets the same order of classes.
    """
    n = lambda name: F.coalesce(F.col(f"feature__{name}"), F.lit(0.0))
    weights = [
        F.lit(40.0),
        n("target_window_packets") + 4 * n("unique_sources_for_destination"),
        12 * n("unique_destinations") + 6 * n("unique_destination_ports"),
        30 * n("connection_count"),
    ]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    raw = F.array(*[w / total for w in weights])
    squares = [w * w for w in weights]
    square_total = squares[0] + squares[1] + squares[2] + squares[3]
    return raw, F.array(*[s / square_total for s in squares])


def verdict_rows(vectors: DataFrame, detector: str = "behaviour", version: str = RULE_MODEL) -> DataFrame:
    """Scored vectors, one row for each entry of ``contexts``: evidence maps hold the available features only."""
    names = sorted(c.removeprefix("feature__") for c in vectors.columns if c.startswith("feature__"))
    numeric = [x for x in names if x != "history_complete"]
    pairs = F.array(*[F.struct(F.lit(x).alias("key"), F.col(f"feature__{x}").alias("value")) for x in numeric])
    held = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    flags = F.create_map(F.lit("history_complete"), F.col("feature__history_complete"))
    none = F.array().cast("array<string>")
    scored = evaluation.score_batch(vectors.withColumn("raw", rule_scores()[0]).withColumn("calibrated", rule_scores()[1]))
    rows = scored.select(
        *FLOW, "trigger_frame", "window_id", "schema_version", "threat_class", "raw_score", "calibrated_confidence",
        F.lit(detector).alias("detector_id"), F.lit(version).alias("model_version"),
        held.alias("evidence"), flags.alias("evidence_flags"),
        none.alias("required_evidence"), none.alias("missing_evidence"), "contexts",
    )
    return rows.withColumn("_context", F.explode("contexts")).select("*", "_context.*").drop("contexts", "_context")


def with_contexts(snapshot_rows: DataFrame) -> DataFrame:
    """Add ``contexts``: what alerts tell of the flow, once for each snapshot it has at this trigger that can be scored.

    Vectors carry it along, so that their wide rows are not joined with the snapshots they come from.
    """
    source_ip, target_ip = flows.orient("a_ip", "b_ip")
    source_port, target_port = flows.orient("a_port", "b_port")
    context = F.struct(
        "flow_id", "last_seen_us", "observed_us",
        source_ip.alias("source_ip"), source_port.alias("source_port"),
        target_ip.alias("destination_ip"), target_port.alias("destination_port"),
        packets.flow_capabilities().alias("capabilities"),
    )
    # Without a source, a destination or a time no window can be read for a snapshot.
    known = source_ip.isNotNull() & target_ip.isNotNull() & F.col("observed_us").isNotNull()
    told = F.when(_can_be_scored() & known, context)
    beside = Window.partitionBy(*FLOW, "trigger_frame")
    return snapshot_rows.withColumn("_context", told).withColumn("contexts", F.collect_list("_context").over(beside)).drop("_context")


def _can_be_scored() -> Column:
    return F.array_contains(packets.scorable(), "behaviour")


def scored_snapshots(snapshot_rows: DataFrame) -> DataFrame:
    """Verdicts of those snapshots with ``contexts`` and windows that can be scored, with their class limits. Rows do not depend on each other."""
    rows = snapshot_rows.where(_can_be_scored()).dropna(subset=[*FLOW, "trigger_frame"])
    return evidence.with_threshold(verdict_rows(features.behaviour_features(rows)), RULE_THRESHOLDS)


def alerts_of_snapshots(snapshot_rows: DataFrame) -> DataFrame:
    """Snapshots through features, score and gate to alerts: what a stream does with each micro-batch, whose rows alone are its contexts."""
    return alerts.build_alerts(evidence.evidence_gate(scored_snapshots(with_contexts(snapshot_rows))))


class Stages:
    """Lazily built stages over one packet table."""

    def __init__(self, packet_rows: DataFrame, width_s: int = 60) -> None:
        self.packets = packet_rows
        self.width_s = width_s

    @cached_property
    def ordered(self) -> DataFrame:
        return packets.canonical_endpoints(packets.drop_out_of_order(packets.known_protocols(self.packets)))

    @cached_property
    def sessions(self) -> DataFrame:
        return flows.sessionize_idle(self.ordered)

    @cached_property
    def flow_packets(self) -> DataFrame:
        return flows.assign_flows(self.ordered)  # read from the table that its last scan stores

    @cached_property
    def flows(self) -> DataFrame:
        return flows.aggregate_flows(self.flow_packets)

    @cached_property
    def identities(self) -> DataFrame:
        return checkpoint(flows.flow_identities(self.flow_packets))

    @cached_property
    def closes(self) -> DataFrame:
        ends = self.flow_packets.groupBy(*FLOW).agg(F.max("ts_us").alias("last_seen_us"))
        return checkpoint(flows.flow_close_events(self.flow_packets, ends, IDLE_US))

    @cached_property
    def ticks(self) -> DataFrame:
        return checkpoint(flows.snapshot_ticks(self.flow_packets))

    @cached_property
    def snapshots(self) -> DataFrame:
        return checkpoint(flows.flow_snapshots(self.flow_packets, self.closes, self.ticks))

    @cached_property
    def named_snapshots(self) -> DataFrame:
        """Snapshots with flow ids, contexts and the width of their windows, stored where they lie by flow."""
        fresh = flows.flow_snapshots(self.flow_packets, self.closes, self.ticks)
        named = with_contexts(fresh.join(self.identities.select(*FLOW, "flow_id"), FLOW))
        return checkpoint(named.withColumn("width_us", F.lit(self.width_s * SECOND_US).cast("long")))

    @cached_property
    def events(self) -> DataFrame:
        return hostwindows.traffic_events(self.flow_packets)

    @cached_property
    def points(self) -> DataFrame:
        return checkpoint(features.snapshot_points(self.named_snapshots, self.width_s))  # several scans ask at them

    @cached_property
    def windows(self) -> DataFrame:
        events = hostwindows.with_widths(self.events, [self.width_s])
        return hostwindows.temporal_snapshot(events, self.points).withColumnRenamed("packet_count", "w_packet_count")

    @cached_property
    def snapshot_rows(self) -> DataFrame:
        """Snapshots with flow ids, contexts and windows."""
        return features.with_windows(self.named_snapshots, self.windows)

    @cached_property
    def behaviour(self) -> DataFrame:
        return features.behaviour_features(self.snapshot_rows)

    def query_counts(self) -> DataFrame:
        """How often a flow's query name was asked by its source inside the window, at its snapshots."""
        c = F.col
        rows = self.snapshot_rows.where(c("dns").isNotNull()).withColumn(
            "domain", F.lower(F.try_element_at(c("dns.queries"), F.lit(1))["name"])
        )
        keys = ["capture_id", "width_us", "src_ip", "domain"]
        asked = rows.where(c("domain").isNotNull()).select(*keys, "ts_us", "trigger_frame").distinct()
        events = hostwindows.with_widths(self.events, [self.width_s]).withColumn("domain", F.explode("domains"))
        seen = hostwindows.sub_key_totals(events, keys, {"query_frequency": F.lit(1)}, points=asked).where("is_point")
        counts = seen.select(*keys, c("at_us").alias("ts_us"), c("seq").alias("trigger_frame"), "query_frequency")
        # A query without a name has no count, and keeps its row.
        return rows.join(counts, [*keys, "ts_us", "trigger_frame"], "left")

    def dns(self, hash_fn: str = "blake2b") -> DataFrame:
        return features.dns_features(self.query_counts(), hash_fn)

    def tls_quic(self, hash_fn: str = "blake2b") -> DataFrame:
        return features.tls_quic_features(self.snapshot_rows, hash_fn)

    @cached_property
    def verdicts(self) -> DataFrame:
        """Scored snapshots of TCP and UDP flows, with everything the gate and the alerts need."""
        return scored_snapshots(self.snapshot_rows)

    @cached_property
    def gated(self) -> DataFrame:
        return evidence.evidence_gate(self.verdicts)

    @cached_property
    def alerts(self) -> DataFrame:
        return checkpoint(alerts.build_alerts(self.gated))

    @cached_property
    def kept_alerts(self) -> DataFrame:
        return checkpoint(alerts.dedupe_alerts(self.alerts))

    @cached_property
    def frame_log(self) -> DataFrame:
        """One row per frame with its fate; frames of no known protocol count as skipped."""
        known = packets.mark_out_of_order(packets.known_protocols(self.packets))
        others = self.packets.where(F.col("protocol") == "OTHER").withColumn("late", F.lit(False))
        marked = known.unionByName(others)
        fresh = self.flow_packets.where("is_new").select("capture_id", "frame_no", F.lit(True).alias("_new"))
        skipped = F.col("protocol") == "OTHER"
        return marked.join(fresh, ["capture_id", "frame_no"], "left").select(
            "capture_id", "frame_no", "ts_us", "protocol",
            F.when(skipped, "skipped").when(F.col("late"), "late").otherwise("parsed").alias("status"),
            F.col("packet_length").alias("frame_length"),
            F.coalesce("_new", F.lit(False)).alias("is_new"),
        )
