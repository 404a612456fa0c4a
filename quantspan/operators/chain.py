"""Hash-chained event log: append, verification, replay into state tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspan.functions.prices import iso_utc
from quantspan.functions.text import canonical_json, chain_step
from quantspan.plans.blocks import carry_in
from quantspan.plans.fold import ordered_fold
from quantspan.schemas import AUDIT_LOG, DOMAINS, columns
from quantspan.session import materialize

ZERO_HASH = "0" * 64
BLOCK = 65_536
CHECKS = ("seq", "payload_hash", "prev_hash", "chain_hash")


def tips(events: DataFrame) -> DataFrame:
    """Last sequence number and hash per chain."""
    return events.groupBy("chain_id").agg(
        F.max("seq").alias("tip_seq"), F.max_by("chain_hash", "seq").alias("tip_hash")
    )


class _Link:
    """Running end of one chain."""

    def __init__(self) -> None:
        self.seq: int | None = None
        self.hash = ZERO_HASH


def _link_rows(state: _Link, rows: pd.DataFrame) -> pd.DataFrame:
    if state.seq is None:
        state.seq, state.hash = int(rows["tip_seq"].iloc[0]), rows["tip_hash"].iloc[0]
    prev, out = [], []
    for payload_hash in rows["payload_hash"]:
        prev.append(state.hash)
        state.hash = hashlib.sha256((state.hash + payload_hash).encode()).hexdigest()
        out.append(state.hash)
    rows = rows.assign(seq=range(state.seq + 1, state.seq + 1 + len(rows)), prev_hash=prev, chain_hash=out)
    state.seq += len(rows)
    return rows[_LINK_COLUMNS]


_LINK_COLUMNS = ["chain_id", "row_key", "payload_hash", "seq", "prev_hash", "chain_hash"]
_LINK_SCHEMA = "chain_id string, row_key string, payload_hash string, seq long, prev_hash string, chain_hash string"


def _ordered(events: DataFrame, order: list[str], row_key: str, existing: DataFrame | None, payload_hash: Column) -> DataFrame:
    """What of new events goes through the fold, with the tips of their chains."""
    hashed = events.select("chain_id", *order, F.col(row_key).cast("string").alias("row_key"), payload_hash.alias("payload_hash"))
    if existing is not None:
        hashed = hashed.join(tips(existing), "chain_id", "left")
    else:
        hashed = hashed.withColumn("tip_seq", F.lit(0).cast("long")).withColumn("tip_hash", F.lit(ZERO_HASH))
    hashed = hashed.fillna({"tip_seq": 0, "tip_hash": ZERO_HASH})
    names = [F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]
    return hashed.select("chain_id", *names, "row_key", "payload_hash", "tip_seq", "tip_hash")


def link_events(events: DataFrame, order: list[str], row_key: str, existing: DataFrame | None = None) -> DataFrame:
    """Give each new event its sequence number and hashes, continuing from the chains' tips.

    Payloads are hashed in parallel; only the 64-character hashes go through the ordered fold,
    which is serial within a chain by definition. Returns ``row_key`` with the link columns, to
    be joined back to the events where their other columns are needed.
    """
    slim = _ordered(events, order, row_key, existing, F.sha2("payload", 256))
    names = [f"__o{i}" for i in range(len(order))]
    return ordered_fold(slim, ["chain_id"], names, lambda _: _Link(), _link_rows, _LINK_SCHEMA)


def _previous_rows(state: _Link, rows: pd.DataFrame) -> pd.DataFrame:
    """As ``_link_rows``, but only what cannot be told from an event itself, in bytes."""
    payload_hashes = [x.hex() for x in rows["payload_hash"]]
    out = _link_rows(state, rows.assign(payload_hash=payload_hashes))
    return out.assign(prev=[bytes.fromhex(x) for x in out["prev_hash"]])[["chain_id", "row_key", "seq", "prev"]]


def numbered_events(
    events: DataFrame,
    order: list[str],
    row_key: str,
    existing: DataFrame | None = None,
    ts: str = "ts",
    canonical: bool = False,
) -> DataFrame:
    """Events with ``seq`` and ``prev``, the bytes of the hash before; all other hashes follow from these and the payload.

    So a row is shuffled with 32 bytes of hashes: ``linked_columns`` makes the others where they are needed.
    ``canonical`` puts JSON payloads made by expressions into canonical form first (sorted keys,
    ASCII, the number format of the log), so that other readers compute the same hash.
    """
    if canonical:
        # written: it is read for the links, for the ranges of the log's files and for its lines
        events = materialize(events.withColumn("payload", canonical_json("payload")), "canonical")
    slim = _ordered(events, order, row_key, existing, F.unhex(F.sha2("payload", 256)))
    names = [f"__o{i}" for i in range(len(order))]
    links = ordered_fold(slim, ["chain_id"], names, lambda _: _Link(), _previous_rows, "chain_id string, row_key string, seq long, prev binary")
    own = ("actor", "event_type", "event_key", "payload")
    rows = events.select("chain_id", F.col(row_key).cast("string").alias("row_key"), F.col(ts).alias("ts"), *own)
    return rows.join(links, ["chain_id", "row_key"]).select("chain_id", "seq", "ts", *own, "prev")


def linked_columns(numbered: DataFrame) -> DataFrame:
    """``numbered_events`` in the event-log columns."""
    rows = numbered.withColumns({"payload_hash": F.sha2("payload", 256), "prev_hash": F.lower(F.hex("prev"))})
    return rows.select(
        "chain_id",
        "seq",
        iso_utc(F.col("ts")).alias("ts_utc"),
        F.unix_millis("ts").alias("ts_ms"),
        "actor",
        "event_type",
        "event_key",
        "payload",
        "payload_hash",
        "prev_hash",
        chain_step(F.col("prev_hash"), F.col("payload_hash")).alias("chain_hash"),
    )


def append_events(
    events: DataFrame,
    order: list[str],
    row_key: str,
    existing: DataFrame | None = None,
    ts: str = "ts",
    canonical: bool = False,
) -> DataFrame:
    """Linked events in the event-log columns, ready for the log sink; see ``numbered_events``."""
    return linked_columns(numbered_events(events, order, row_key, existing, ts, canonical))


def _failure(checks: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def check_links(events: DataFrame, position: str, check_seq: bool = True) -> DataFrame:
    """Rows with ``failure``: the first check a row breaks, or NULL.

    ``events`` has chain_id, ``position``, computed_hash, payload_hash, prev_hash, chain_hash.
    Rows are looked at in blocks of positions; the hash before a block comes from the block
    totals, so one long chain is verified by many tasks.
    """
    rows = events.withColumn("__b", F.floor(F.col(position) / BLOCK).cast("long"))
    carried = carry_in(
        rows, ["chain_id"], "__b", {"__h": F.max_by("chain_hash", position)}, {"__before": F.last("__h")}
    )
    part = Window.partitionBy("chain_id", "__b").orderBy(position)
    rows = rows.withColumn("__lag", F.lag("chain_hash").over(part)).join(carried, ["chain_id", "__b"], "left")
    expected = F.coalesce("__lag", "__before", F.lit(ZERO_HASH))
    checks = [
        ("payload_hash", F.col("computed_hash") == F.col("payload_hash")),
        ("prev_hash", F.col("prev_hash") == expected),
        ("chain_hash", chain_step(F.col("prev_hash"), F.col("payload_hash")) == F.col("chain_hash")),
    ]
    if check_seq:
        checks.insert(0, ("seq", F.col("seq") == F.col(position)))
    return rows.withColumn("failure", _failure(checks)).drop("__b", "__lag", "__before")


def verify_log(events: DataFrame, position: str = "line_no", check_seq: bool = True) -> DataFrame:
    """One row per chain: number of events, validity, and the first failing row with its check."""
    cols = ["chain_id", position, "computed_hash", "payload_hash", "prev_hash", "chain_hash"]
    if check_seq and "seq" not in cols:
        cols.append("seq")
    checked = check_links(events.select(*dict.fromkeys(cols)), position, check_seq)
    at = F.when(F.col("failure").isNotNull(), F.col(position))
    return checked.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.count("failure") == 0).alias("ok"),
        F.min(at).alias("first_bad"),
        F.min_by("failure", at).alias("first_failure"),
        F.max_by("chain_hash", position).alias("tip"),
    )


def verify_table(audit: DataFrame) -> DataFrame:
    """Verify a projected audit table by row id, without the sequence check."""
    if "chain_id" not in audit.columns:
        audit = audit.withColumn("chain_id", F.lit("audit"))
    return verify_log(audit.withColumn("computed_hash", F.sha2("payload_json", 256)), "id", check_seq=False)


def agreement(log_result: DataFrame, table_result: DataFrame) -> DataFrame:
    """Log and table verdicts side by side; they agree when both are valid with one tip."""
    a = log_result.select("chain_id", F.col("ok").alias("log_ok"), F.col("n_events").alias("log_n"), F.col("tip").alias("log_tip"))
    b = table_result.select(
        "chain_id", F.col("ok").alias("table_ok"), F.col("n_events").alias("table_n"), F.col("tip").alias("table_tip")
    )
    both = a.join(b, "chain_id", "full_outer")
    agree = F.col("log_ok") & F.col("table_ok") & F.col("log_tip").eqNullSafe(F.col("table_tip"))
    return both.withColumn("agree", F.coalesce(agree, F.lit(False)))


def missing_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events of ``left`` whose chain hash is not in ``right``."""
    return left.join(right.select("chain_id", "chain_hash"), ["chain_id", "chain_hash"], "left_anti")


def replay(events: DataFrame) -> DataFrame:
    """Audit table rebuilt from the log: the row id is the sequence number."""
    return events.select(
        "chain_id",
        F.col("seq").alias("id"),
        F.timestamp_millis("ts_ms").alias("ts"),
        *[c if c != "payload_json" else F.col("payload").alias(c) for c in columns(AUDIT_LOG)[2:]],
    )


def _at(event: Column, value: Column) -> Column:
    """The value at the last row where ``event`` holds."""
    return F.max_by(value, F.when(event, F.col("seq")))


_DECISION = (
    "action STRING, id STRING, title STRING, status STRING, owner STRING, vault_path STRING, "
    "content_hash STRING, superseded_by STRING"
)


#: What is kept of a decision's events: the last of each kind, with what it says.
DECISION_PARTS = (
    "chain_id string, id string, made long, accepted long, superseded long, "
    "c struct<ts: timestamp, title: string, status: string, owner: string, vault_path: string, content_hash: string>, `by` string"
)


def decision_parts(events: DataFrame) -> DataFrame:
    """The last ``create``, ``accept`` and ``supersede`` of each decision, one aggregation per id."""
    rows = events.where("event_type = 'decision'").select(
        "chain_id", "seq", F.timestamp_millis("ts_ms").alias("ts"), F.from_json("payload", _DECISION).alias("p")
    )
    act = F.col("p.action")
    made = F.struct("ts", *[F.col(f"p.{x}").alias(x) for x in ("title", "status", "owner", "vault_path", "content_hash")])
    return rows.groupBy("chain_id", F.col("p.id").alias("id")).agg(
        F.max(F.when(act == "create", F.col("seq"))).alias("made"),
        F.max(F.when(act == "accept", F.col("seq"))).alias("accepted"),
        F.max(F.when(act == "supersede", F.col("seq"))).alias("superseded"),
        _at(act == "create", made).alias("c"),
        _at(act == "supersede", F.col("p.superseded_by")).alias("by"),
    )


def merge_decisions(parts: DataFrame) -> DataFrame:
    """Parts of several batches as parts of all of them."""
    return parts.groupBy("chain_id", "id").agg(
        *[F.max(x).alias(x) for x in ("made", "accepted", "superseded")], F.max_by("c", "made").alias("c"), F.max_by("by", "superseded").alias("by")
    )


def decision_view(parts: DataFrame) -> DataFrame:
    """The decision table.

    ``create`` replaces the row, ``accept`` and ``supersede`` change the row that exists, so
    each counts only after the last ``create``; updates of an unknown id do nothing.
    """
    made = F.col("made")
    acc, sup = F.when(F.col("accepted") > made, F.col("accepted")), F.when(F.col("superseded") > made, F.col("superseded"))
    status = (
        F.when(F.coalesce(acc, F.lit(-1)) > F.coalesce(sup, F.lit(-1)), F.lit("accepted"))
        .when(sup.isNotNull(), F.lit("superseded"))
        .otherwise(F.coalesce("c.status", F.lit("proposed")))
    )
    return parts.where(made.isNotNull()).select(
        "chain_id",
        "id",
        F.col("c.title").alias("title"),
        status.alias("status"),
        F.coalesce("c.owner", F.lit("unknown")).alias("owner"),
        F.col("c.ts").alias("created"),
        F.when(sup.isNotNull(), F.col("by")).alias("superseded_by"),
        F.col("c.vault_path").alias("vault_path"),
        F.col("c.content_hash").alias("content_hash"),
        F.greatest(made, acc, sup).alias("audit_id"),
    )


def replay_decisions(events: DataFrame) -> DataFrame:
    """Decision table from its events."""
    return decision_view(decision_parts(events))


_RULE = (
    "op STRING, id STRING, rule_type STRING, instrument STRING, "
    "window_spec STRUCT<event: STRING, event_ts: TIMESTAMP, pre_min: DOUBLE, post_min: DOUBLE>, "
    "action STRING, params MAP<STRING,STRING>, vault_path STRING, active INT"
)


#: What is kept of a rule's events.
RULE_PARTS = (
    "chain_id string, id string, made long, stopped long, "
    "c struct<ts: timestamp, rule_type: string, instrument: string, "
    "window_spec: struct<event: string, event_ts: timestamp, pre_min: double, post_min: double>, "
    "action: string, params: map<string,string>, active: int>"
)


def _rule_rows(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'ontology_rule'").select(
        "chain_id", "seq", F.timestamp_millis("ts_ms").alias("ts"), F.from_json("payload", _RULE).alias("p")
    )
    legal = F.coalesce(F.col("p.action").isin(*DOMAINS["rule_action"]), F.lit(False))
    return rows.withColumns({"op": F.coalesce("p.op", F.lit("create")), "legal": legal})


def rule_parts(events: DataFrame) -> DataFrame:
    """The last legal ``create`` and the last ``deactivate`` of each rule; a rule may only restrict."""
    made = F.struct("ts", *[F.col(f"p.{x}").alias(x) for x in ("rule_type", "instrument", "window_spec", "action", "params", "active")])
    op = F.col("op")
    return (
        _rule_rows(events)
        .where((op == "deactivate") | F.col("legal"))
        .groupBy("chain_id", F.col("p.id").alias("id"))
        .agg(
            F.max(F.when(op == "create", F.col("seq"))).alias("made"),
            F.max(F.when(op == "deactivate", F.col("seq"))).alias("stopped"),
            _at(op == "create", made).alias("c"),
        )
    )


def merge_rules(parts: DataFrame) -> DataFrame:
    """Parts of several batches as parts of all of them."""
    return parts.groupBy("chain_id", "id").agg(F.max("made").alias("made"), F.max("stopped").alias("stopped"), F.max_by("c", "made").alias("c"))


def rule_view(parts: DataFrame) -> DataFrame:
    """The rule table."""
    off = F.coalesce(F.col("stopped") > F.col("made"), F.lit(False))
    return parts.where("made is not null").select(
        "chain_id",
        "id",
        F.col("c.ts").alias("ts"),
        F.col("c.rule_type").alias("rule_type"),
        F.col("c.instrument").alias("instrument"),
        F.col("c.window_spec").alias("window"),
        F.col("c.action").alias("action"),
        F.col("c.params").alias("params"),
        F.when(off, F.col("stopped")).otherwise(F.col("made")).alias("audit_id"),
        (~off & (F.coalesce("c.active", F.lit(1)) == 1)).alias("active"),
    )


def replay_rules(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule table, rejected create events) from rule events."""
    rejected = _rule_rows(events).where((F.col("op") == "create") & ~F.col("legal")).select("chain_id", "seq", "ts", "p.*")
    return rule_view(rule_parts(events)), rejected


def trade_events(trades: DataFrame) -> DataFrame:
    """Log events of trades (payload keys in sorted order)."""
    return trades.select(
        "ts",
        F.concat(F.lit("agent:sleeve:"), "sleeve_id").alias("actor"),
        F.lit("trade").alias("event_type"),
        F.col("sleeve_id").alias("event_key"),
        F.to_json(
            F.struct(
                "instrument", "side", F.col("size_target").cast("int").alias("size"), "status",
                F.col("id").alias("trade_id"), "verdict",
            )
        ).alias("payload"),
    )
