"""Event log: append, read, tamper detection, replay."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quantspan.functions.text import canonical_json, chain_step
from quantspan.operators import chain, ontology
from quantspan.sources.logs import append_log, log_lines, read_log

NOW = dt.datetime(2026, 1, 1)
PAYLOADS = ['{"a":1}', '{"rate":1e-05,"x":1.0}', '{"name":"\\u00f1and\\u00fa"}', '{"q":"\\"payload\\":{}"}', '{"n":{"payload":{"z":null}}}']


def _events(spark, payloads=PAYLOADS, chain_id="log"):
    rows = [(chain_id, i, NOW + dt.timedelta(seconds=i), "me", "trade", None if i == 1 else f"k{i}", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(
        rows, "chain_id string, i int, ts timestamp, actor string, event_type string, event_key string, payload string"
    )


def python_log(payloads):
    """The log as an independent writer would put it."""
    prev, out = "0" * 64, []
    for i, p in enumerate(payloads, 1):
        obj = json.loads(p)
        canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
        ph = hashlib.sha256(canon(obj).encode()).hexdigest()
        link = hashlib.sha256((prev + ph).encode()).hexdigest()
        out.append(
            canon({"seq": i, "ts_utc": "2026-01-01T00:00:00.000Z", "ts_ms": 0, "actor": "me", "event_type": "trade",
                   "event_key": None, "payload": obj, "payload_hash": ph, "prev_hash": prev, "chain_hash": link})
        )
        prev = link
    return out


def _write(tmp_path, lines, name="log.ndjson"):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def _verify(spark, tmp_path, lines):
    return chain.verify_log(read_log(spark, _write(tmp_path, lines))).first()


def test_foreign_log_verifies(spark, tmp_path):
    lines = python_log(PAYLOADS)
    row = _verify(spark, tmp_path, [lines[0], "", *lines[1:], "   "])
    assert row.ok and row.n_events == 5 and row.chain_id == "log" and row.first_bad is None


def test_whitespace_is_not_tampering(spark, tmp_path):
    lines = python_log(PAYLOADS)
    lines[1] = json.dumps(json.loads(lines[1]), indent=None, separators=(", ", ": "))
    assert _verify(spark, tmp_path, lines).ok


@pytest.mark.parametrize(
    "edit,where,what",
    [
        (lambda e: e[1].update(payload={"rate": 2}), 2, "payload_hash"),
        (lambda e: e[2].update(prev_hash="f" * 64), 3, "prev_hash"),
        (lambda e: e[3].update(chain_hash="e" * 64), 4, "chain_hash"),
        (lambda e: e.pop(1), 2, "seq"),
        (lambda e: e.insert(0, e.pop(2)), 1, "seq"),
        (lambda e: e[4].update(payload=e[3]["payload"], payload_hash=e[3]["payload_hash"]), 5, "chain_hash"),
    ],
)
def test_tampering_is_found(spark, tmp_path, edit, where, what):
    events = [json.loads(x) for x in python_log(PAYLOADS)]
    edit(events)
    row = _verify(spark, tmp_path, [json.dumps(e, sort_keys=True, separators=(",", ":")) for e in events])
    assert not row.ok and (row.first_bad, row.first_failure) == (where, what)


def test_missing_log_is_empty(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0


def test_append_continues_and_reads_back(spark, tmp_path):
    root = str(tmp_path / "logs")
    ev = _events(spark)
    append_log(chain.append_events(ev.where("i < 2"), ["i"], "i"), root)
    append_log(chain.append_events(ev.where("i >= 2"), ["i"], "i", read_log(spark, root)), root)
    back = read_log(spark, root)
    assert [r.payload for r in back.orderBy("line_no").collect()] == PAYLOADS
    row = chain.verify_log(back).first()
    assert row.ok and row.n_events == 5
    first = back.orderBy("seq").first()
    assert first.prev_hash == chain.ZERO_HASH and first.ts_utc == "2026-01-01T00:00:00.000Z"
    assert json.loads(log_lines(back.where("seq = 2")).first().line)["event_key"] is None


def test_links_are_blocked_but_serial(spark, monkeypatch):
    monkeypatch.setattr(chain, "BLOCK", 3)
    ev = _events(spark, [json.dumps({"i": i}) for i in range(50)]).unionByName(_events(spark, ['{"b":1}'], "other"))
    log = chain.append_events(ev, ["i"], "i").withColumn("computed_hash", F.sha2("payload", 256))
    rows = {r.chain_id: r for r in chain.verify_log(log, "seq").collect()}
    assert rows["log"].ok and rows["log"].n_events == 50 and rows["other"].ok
    want = json.loads(python_log([json.dumps({"i": i}) for i in range(50)])[-1])
    canon = chain.append_events(_events(spark, ['{"i":%d}' % i for i in range(50)]), ["i"], "i")
    assert canon.where("seq = 50").first().chain_hash == want["chain_hash"]


def test_chain_step_needs_full_hashes(spark):
    assert spark.range(1).select(chain_step(F.lit("ab"), F.lit("0" * 64)).alias("x")).first().x is None


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1e-05, "a": "ñ"}',)], "s string")
    assert df.select(canonical_json("s").alias("x")).first().x == '{"a":"\\u00f1","b":1e-05}'


def test_log_lines_are_parsed_once(spark, tmp_path):
    append_log(chain.append_events(_events(spark), ["i"], "i"), str(tmp_path))
    plan = read_log(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_payloads_are_made_canonical_once(spark):
    loose = [json.dumps(json.loads(p), indent=1) for p in PAYLOADS]
    events = chain.append_events(_events(spark, loose), ["i"], "i", canonical=True)
    assert [r.payload for r in events.orderBy("seq").collect()] == [json.dumps(json.loads(p), sort_keys=True, separators=(",", ":")) for p in PAYLOADS]
    assert "canonical_json(" not in events._jdf.queryExecution().optimizedPlan().toString()


def test_table_replay_and_agreement(spark):
    log = chain.append_events(_events(spark), ["i"], "i")
    table = chain.replay(log)
    ok = chain.verify_log(log.withColumn("computed_hash", F.sha2("payload", 256)), "seq")
    assert chain.agreement(ok, chain.verify_table(table)).first().agree
    cut = table.withColumn("payload_json", F.when(F.col("id") == 3, F.lit("{}")).otherwise(F.col("payload_json")))
    res = chain.verify_table(cut).first()
    assert not res.ok and (res.first_bad, res.first_failure) == (3, "payload_hash")
    assert not chain.agreement(ok, chain.verify_table(cut)).first().agree
    assert chain.missing_links(log, table.where("id <> 2")).first().seq == 2


def _log(spark, kind, payloads):
    rows = [("c", i, i * 1000, kind, json.dumps(p)) for i, p in enumerate(payloads, 1)]
    return spark.createDataFrame(rows, "chain_id string, seq long, ts_ms long, event_type string, payload string")


def test_decision_replay(spark):
    made = lambda i, **k: {"action": "create", "id": i, "title": f"t{i}", "vault_path": "p", "content_hash": "h", **k}
    act = lambda a, i, **k: {"action": a, "id": i, **k}
    log = _log(
        spark, "decision",
        [act("accept", "D1"), made("D1"), made("D2", owner="x"), act("accept", "D2"), act("supersede", "D2", superseded_by="D3"),
         made("D3"), act("accept", "D3"), made("D3", title="new"), act("accept", "D9"), act("supersede", "D1", superseded_by="D3"),
         act("accept", "D1")],
    )
    got = {r.id: (r.status, r.superseded_by, r.audit_id, r.title, r.owner) for r in chain.replay_decisions(log).collect()}
    assert got == {
        "D1": ("accepted", "D3", 11, "tD1", "unknown"),
        "D2": ("superseded", "D3", 5, "tD2", "x"),
        "D3": ("proposed", None, 8, "new", "unknown"),
    }


def test_rule_replay(spark):
    rule = lambda i, a="veto", **k: {"id": i, "rule_type": "t", "action": a, **k}
    log = _log(
        spark, "ontology_rule",
        [rule("A", params={"size_mult": "0.3"}), rule("B", "approve"), rule("C"), {"op": "deactivate", "id": "A"},
         {"op": "deactivate", "id": "C"}, rule("C", "size_down", op="create"), {"op": "deactivate", "id": "Z"},
         rule("W", window_spec={"event_ts": "2026-06-18T18:00:00+00:00", "pre_min": 30, "post_min": 5})],
    )
    table, bad = chain.replay_rules(log)
    got = {r.id: r for r in table.collect()}
    assert {k: (v.active, v.action, v.audit_id) for k, v in got.items()} == {
        "A": (False, "veto", 4), "C": (True, "size_down", 6), "W": (True, "veto", 8)
    }
    assert got["W"].window.event_ts == dt.datetime(2026, 6, 18, 18) and got["A"].params == {"size_mult": "0.3"}
    assert [r.id for r in bad.collect()] == ["B"]


def test_injected_rule_reaches_the_table(spark):
    req = spark.createDataFrame(
        [(NOW, "No NQ", "veto", None, "event_window", "NQ", "ana", ("FOMC", dt.datetime(2026, 6, 18, 18), 30.0, 30.0), {"size_mult": "0.5"})],
        "ts timestamp, description string, action string, rule_id string, rule_type string, instrument string, owner string, "
        "window struct<event:string,event_ts:timestamp,pre_min:double,post_min:double>, params map<string,string>",
    )
    ok, _ = ontology.split_requests(req)
    ev = ontology.injection_events(ok).withColumn("chain_id", F.lit("c"))
    table, _ = chain.replay_rules(chain.append_events(ev, ["ts"], "event_key"))
    row = table.first()
    assert (row.id, row.instrument, row.active, row.window.pre_min) == ("rule_no_nq", "NQ", True, 30.0)
