"""Envelopes, store, batches, delivery, sources and streams."""

import dataclasses
import itertools
import json
import os
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from callmill.functions import json_text, policy
from callmill.operators import batching, delivery, envelope, reports, store, verdict
from callmill.sources import records as source
from callmill.sources.delivery_log import DeliveryLog, Fenced
from callmill.streaming import capture

from .test_assembly import START, STOP, stream

EXCHANGE = (
    "provider string, endpoint string, http_status int, client_version string, project_id_hash string, at string, upstream string, official_upstream string, request binary, request_complete boolean, "
    "response binary, response_complete boolean, content_type string, content_encoding string, upstream_request_id string, anthropic_version string, anthropic_beta array<string>"
)


def exchange(**changes):
    row = {
        "provider": "p", "endpoint": "/v1/messages", "http_status": 200, "client_version": "1.2.3", "project_id_hash": "h", "at": "2024-05-06T07:08:09.000000005Z", "upstream": "https://a/", "official_upstream": "https://a",
        "request": b'{"n":1.10,"metadata":{"user_id":"u1"}}', "request_complete": True, "response": b'{"id":"m1"}', "response_complete": True, "content_type": "application/json", "content_encoding": "",
        "upstream_request_id": "", "anthropic_version": "v", "anthropic_beta": None,
    }
    return tuple((row | changes).values())


def frame(spark, *rows):
    return spark.createDataFrame(rows, EXCHANGE)


def test_classification(spark):
    sse = stream(START, STOP).encode()
    events = {"content_type": "text/event-stream"}
    cases = [
        (exchange(), (False, "none")), (exchange(content_encoding="br"), (True, "none")), (exchange(response=sse, **events), (False, "client")), (exchange(response=b"oops\n\n", **events), (True, "none")),
        (exchange(response=sse, response_complete=False, **events), (True, "none")), (exchange(response=b"text"), (True, "none")), (exchange(response=b'{"a"'), (True, "none")), (exchange(request_complete=False), (True, "none")),
        (exchange(response=None), (True, "none")),
    ]
    got = envelope.classified(frame(spark, *(c for c, _ in cases))).select("garbled", "assembled_by").collect()
    assert [tuple(r) for r in got] == [w for _, w in cases]


def test_record_text(spark):
    row = envelope.records(frame(spark, exchange(anthropic_beta=["b1", "b2"])), "9.9.9").first()
    assert row["data"] == (
        '{"schema_version":"1","source":"proxy","provider":"p","endpoint":"/v1/messages","request_id":"m1","capture":{"http_status":200,"client_version":"1.2.3","timestamp":"2024-05-06T07:08:09.000000005Z",'
        '"project_id_hash":"h","upstream_origin":"official","sse_assembly":{"by":"none"},"garbled":false},"format_hints":{"anthropic-version":"v","anthropic-beta":["b1","b2"]},'
        '"request":{"n":1.10,"metadata":{"user_id":"u1"}},"response":{"id":"m1"}}'
    )
    assert row["session_key"] == "u1"


def test_ids(spark):
    rows = frame(spark, exchange(), exchange(response=b"{}", upstream_request_id="req_1"), exchange(response=b'{"id":"../x"}'), exchange(response=b"{}"))
    ids = [r["request_id"] for r in envelope.records(rows, "1").collect()]
    assert ids[:2] == ["m1", "req_1"]
    assert all(i.startswith("local-") and len(i) == 38 for i in ids[2:])


def test_parsing(spark):
    good = envelope.records(frame(spark, exchange()), "1").select("data")
    rows = good.union(spark.createDataFrame([("{",), ('{"schema_version":"99"}',)], "data string"))
    assert [r["parse_error"] for r in envelope.parsed(rows).collect()] == [None, "invalid JSON", "unknown schema version 99"]
    hashes = spark.createDataFrame([('{"capture":{"project_id_hash":"x"}}',), ('{"capture":{"project_id_hash":"x"}',), ('{"capture":{"project_id_hash":""}}',)], "data string")
    assert [r[0] for r in hashes.select(envelope.lenient_project_hash(F.col("data"))).collect()] == ["x", None, None]


def test_numbers_keep_their_spelling():
    text = '{"a":1.10,"b":9007199254740993,"c":[1e5,"<&>"]}'
    assert json_text.encode(json_text.decode(text)) == '{"a":1.10,"b":9007199254740993,"c":[1e5,"\\u003c\\u0026\\u003e"]}'
    assert not any(map(json_text.is_valid, ["", "1 2", "NaN", "{", None]))


def test_policy(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(policy.nanos_fraction(F.lit("2024-05-06T07:08:09.000000005Z"))) == 5
    assert get(policy.parse_instant(F.lit("soon"))) is None
    assert [get(policy.is_credential_safe(F.lit(u))) for u in ("https://x", "http://localhost:1", "http://x", "", "::")] == [True, True, False, False, False]
    assert get(policy.version_standing(F.lit("1.0.0"), F.lit("1.0.0-rc.1"))) == "behind"
    assert get(policy.is_safe_batch_id(F.lit(".."))) is False
    assert get(policy.human_bytes(F.lit(1536))) == "1.5 KiB"
    assert get(policy.retry_after(F.lit("Sat, 01 Jun 2024 00:01:00 GMT"), F.lit("2024-06-01 00:00:00").cast("timestamp"))) == 60
    assert verdict.agreement_pause("1", "2", "") == "consent_reconfirm"
    assert verdict.resume("signed_out", "consent_reconfirm") == "signed_out"


def test_a_service_s_own_words(spark):
    """A character that the cut splits is dropped; what shows nothing is a space, and runs of it are one."""
    odd = {"€" * 2000: "€" * 400 + "…", " " * 4095 + "é": "", "x" + " " * 4094 + "éé": "x", "\u3000a\u2028\u00a0\u200b\tb\ufffdc\ue000": "a bc", "": "", "a" * 400: "a" * 400, None: None}
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", policy.service_details(F.col("t")).alias("said")).collect()
    assert {r["t"]: r["said"] for r in got} == odd


def test_routes(spark):
    routes = spark.createDataFrame([("t1", "h1", "/a", "u", "g", ""), ("t2", "h2", "/b", "u", "g", "r")], capture.ROUTES)
    tokens = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "token string")
    seen = lambda pause: [r["decision"] for r in verdict.selfcheck(tokens, routes, pause, "u", 1, 2).orderBy("token").collect()]
    assert seen("") == ["record", "revoked", "unknown"]
    assert seen("signed_out") == ["paused", "revoked", "unknown"]
    assert verdict.active_grants(verdict.revoke(routes, "/a", "now")).count() == 0
    again = verdict.grant(routes, spark.createDataFrame([("t9", "h1", "/a", "u", "g", "")], capture.ROUTES))
    assert sorted(r["token"] for r in again.collect()) == ["t2", "t9"]
    assert [r["gave_up"] for r in reports.crash_gave_up(spark.createDataFrame([("p", 0), ("p", 5), ("p", 6), ("p", 99)], "process string, at long"), 10, 2).orderBy("at").collect()] == [False, False, True, False]


class Scripted:
    """A sink that answers from a list; the last answer stays."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def deliver(self, batch):
        row = batch.first()
        self.seen.append((row["batch_id"], row["n_records"]))
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        return dataclasses.replace(answer, batch_id=row["batch_id"]) if 200 <= answer.status < 300 and not answer.batch_id else answer


@pytest.fixture
def folders(tmp_path):
    count = itertools.count()
    return lambda: str(tmp_path / f"spool{next(count)}")


def spool_rows(spark, n=4, broken=()):
    rows = [(f"r{i}", f"s{i % 2}", f"2024-01-0{1 + i // 2}T00:00:0{i}Z", "h", envelope_text(i) if i not in broken else "{") for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, session_key string, timestamp string, project_id_hash string, data string")


def spool(spark, path, n=4, broken=()):
    if n:
        source.write_records(spool_rows(spark, n, broken), path, 0)
    return source.TableSpool(spark, path)


def envelope_text(i):
    return json.dumps({"schema_version": "1", "endpoint": "e", "request_id": f"r{i}", "capture": {"http_status": 200, "timestamp": "2024-01-01T00:00:00Z", "project_id_hash": "h", "garbled": False}, "request": {"mail": "a@b.example.com"}, "response": {"signature": "keep"}})


OK, NOW, SIZE = delivery.Response(200), 1_704_067_200 + 60, len(envelope_text(0))


def test_batches_round_trip(spark, folders):
    rows = batching.masked_batches(spool(spark, folders()).rows().withColumn("batch_id", F.lit("b1")))
    packed = batching.pack_batches(rows, "1", "now", lambda batch_id: {"of": batch_id})
    head = json.loads(packed.first()["envelope"])
    assert [i["request_id"] for i in head["records"]] == ["r0", "r2", "r1", "r3"]
    assert head["records_size"] == sum(i["size"] for i in head["records"])
    assert head["run"] == {"of": "b1"}
    data = [json.loads(r["data"]) for r in batching.unpack_batches(packed).collect()]
    assert all(d["request"]["mail"] == "[REDACTED_EMAIL]" and d["response"]["signature"] == "keep" for d in data)


def test_a_large_batch_has_parts(spark, folders, monkeypatch):
    """Parts joined are the batch in its order, whatever task made them, and a flush counts all of them."""
    monkeypatch.setattr(batching, "PART_BYTES", 2 * SIZE)
    store_ = spool(spark, folders(), 9)
    rows = store_.rows().withColumn("batch_id", F.lit("b1"))
    held = lambda df: df.localCheckpoint()
    whole = batching.masked_batches(rows).orderBy("position").select("request_id", "position", "offset").collect()
    spread = batching.placed(batching.masked(rows).repartition(5), held)
    assert spread.orderBy("position").select("request_id", "position", "offset").collect() == whole
    packed = batching.pack_batches(spread, "1", "now").orderBy("part").collect()
    assert len(packed) > 2
    items = [i for p in packed for i in json.loads(p["envelope"])["records"]]
    assert [(i["request_id"], i["offset"]) for i in items] == [(r["request_id"], r["offset"]) for r in whole]
    assert [p["start"] for p in packed] == list(itertools.accumulate([0, *(p["records_size"] for p in packed)]))[:-1]
    back = {r["request_id"]: r["data"] for r in batching.unpack_batches(spark.createDataFrame(packed, batching.PACKED)).collect()}
    assert back == {r["request_id"]: r["data"] for r in batching.masked(rows).collect()}
    out = delivery.flush(store_, delivery.State(), Scripted(OK), NOW, force=True)
    assert (out.records, out.state.receipt["records"], store_.rows().count()) == (9, 9, 0)


def test_many_batches_are_packed_in_few_jobs(spark, folders, monkeypatch):
    """Bins beyond the first are packed together; rows that can't be read, and those that others withdrew meanwhile, are not sent."""
    store_, made = spool(spark, folders(), 8, broken=(5,)), []
    pack = delivery._pack
    monkeypatch.setattr(delivery, "_pack", lambda *args: made.append(1) or pack(*args))
    sink = Scripted(OK)
    out = delivery.flush(store_, delivery.State(handshake={"flush_bytes": 9}), sink, NOW, force=True)
    assert (out.outcome, out.batches, out.records, out.unreadable, len(made), store_.rows().count()) == ("uploaded", 7, 7, 1, 2, 0)
    store_, sink = spool(spark, folders(), 8), Scripted(OK)
    last, deliver = store_.rows().where("request_id = 'r7'"), sink.deliver

    def meanwhile(batch):
        if len(sink.seen) == 3:
            store_.remove(last)
        return deliver(batch)

    sink.deliver = meanwhile
    out = delivery.flush(store_, delivery.State(handshake={"flush_bytes": 9}), sink, NOW, force=True)
    assert (out.outcome, out.records, store_.rows().count()) == ("uploaded", 7, 0)


def test_ids_that_are_packed_together_are_not_broadcast(spark, folders, monkeypatch):
    """They take little room in files, by which Spark decides, and much on the driver."""
    store_, n, sink, seen, pack = source.TableSpool(spark, folders()), 600, Scripted(OK), [], delivery._pack
    store_.write(spark.range(n).select(F.format_string("r%09d", "id").alias("request_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit('{"schema_version":"1"}').alias("data")), 0)

    def watched(spool, rows, *rest):
        seen.append((len(rows.collect()), rows._jdf.queryExecution().executedPlan().toString()))
        return pack(spool, rows, *rest)

    monkeypatch.setattr(delivery, "_pack", watched)
    out = delivery.flush(store_, delivery.State(handshake={"flush_bytes": 22 * 200}), sink, NOW, force=True)
    assert (out.outcome, out.batches, out.records, store_.rows().count()) == ("uploaded", 3, n, 0)
    assert [k for _, k in sink.seen] == [200] * 3
    assert [k for k, _ in seen] == [200, 400] and "SortMergeJoin" in seen[1][1]
    assert all("Broadcast" not in plan for _, plan in seen)


def test_packing_reads_the_rows_between_its_first_and_its_last(spark):
    """Bins go on from day to day; what lies before and behind is left out."""
    rows = spark.createDataFrame([(f"2024010{d}", f"r{i}") for d in range(1, 5) for i in range(4)], "day string, request_id string")
    spans = [{"day": d, "after": a, "last": b} for d, a, b in (("20240104", "", "r1"), ("20240102", "r1", "r2"), ("20240102", "r2", "r3"), ("20240103", "", "r3"))]
    found = [(r["day"][-1], r["request_id"]) for r in rows.where(delivery._across(spans)).orderBy("day", "request_id").collect()]
    assert found == [("2", "r2"), ("2", "r3"), *(("3", f"r{i}") for i in range(4)), ("4", "r0"), ("4", "r1")]


def test_flush_outcomes(spark, folders):
    flush = lambda sink=OK, n=4, state=delivery.State(), now=NOW, **o: delivery.flush(spool(spark, folders(), n), state, Scripted(sink), now, **o)
    assert flush().outcome == "below_threshold"
    assert flush(signed_in=False).outcome == "paused"
    assert flush(n=0).outcome == "empty"
    assert (flush(now=NOW + 90_000).outcome, flush(now=NOW + 90_000).records) == ("uploaded", 4)
    small = delivery.State(handshake={"flush_bytes": int(1.5 * SIZE)})
    for at_once in (1, 2, 5):
        out = flush(state=small, at_once=at_once)
        assert (out.outcome, out.batches, out.records, out.state.receipt["records"]) == ("uploaded", 2, 4, 2)
    late = flush(force=True, budget=0)
    assert (late.outcome, late.error, late.state.pending) == ("empty", "budget spent", ())


def test_flush_failures(spark, folders):
    store_ = spool(spark, folders())
    late = delivery.flush(store_, delivery.State(), Scripted(delivery.Response(408)), NOW, force=True)
    assert (late.outcome, late.state.not_before, late.state.last_attempt, store_.rows().count()) == ("deferred", NOW + 60, NOW, 4)
    assert delivery.flush(store_, late.state, Scripted(OK), NOW + 1).outcome == "deferred"
    twice = delivery.flush(store_, late.state, Scripted(delivery.Response(408)), NOW + 1, force=True)
    assert (twice.state.timeouts, twice.state.not_before, twice.state.pending) == (2, NOW + 1 + 120, late.state.pending)
    sink = Scripted(OK)
    again = delivery.flush(store_, twice.state, sink, NOW + 2, force=True)
    assert sink.seen == [(late.state.pending[0], 4)]
    assert (again.outcome, again.state.timeouts, store_.rows().count()) == ("uploaded", 0, 0)
    store_ = spool(spark, folders())
    for wait, pause in ((7, 7), (0, 300), (99_999, 3600)):
        assert delivery.flush(store_, delivery.State(), Scripted(delivery.Response(429, retry_after=wait)), NOW, force=True).state.not_before == NOW + pause
    behind = delivery.flush(store_, delivery.State(), Scripted(delivery.Response(426, min_client_version="2")), NOW, force=True)
    assert (behind.outcome, behind.state.min_client_version) == ("upgrade_required", "2")
    assert delivery.flush(store_, behind.state, Scripted(OK), NOW).outcome == "upgrade_required"
    wrong = delivery.flush(store_, delivery.State(), Scripted(delivery.Response(200, "other")), NOW, force=True)
    assert (wrong.outcome, store_.rows().count()) == ("paused", 4)
    assert delivery.flush(store_, wrong.state, Scripted(delivery.Response(401)), NOW, force=True).outcome == "paused"


def test_acknowledgements_change_settings(spark, folders):
    out = delivery.flush(spool(spark, folders()), delivery.State(handshake={"flush_bytes": 9, "notice": "old"}), Scripted(delivery.Response(200, handshake={"quota_bytes": 77, "notice": "", "flush_bytes": 0})), NOW, force=True)
    assert (out.state.handshake, out.state.quota) == ({"flush_bytes": 9, "notice": "old", "quota_bytes": 77}, 77)
    assert delivery.State().quota == policy.QUOTA_BYTES


def test_quarantine(spark, folders):
    store_ = spool(spark, folders())
    out = delivery.flush(store_, delivery.State(), Scripted(delivery.Response(400, details="no")), NOW, force=True, new_id=lambda: "b1")
    assert (out.outcome, out.state.pending, out.state.last_rejected, store_.rows().count(), store_.rejected().count()) == ("rejected", (), "b1: 4 records", 0, 4)
    assert reports.quarantine_list(store_.rejected()).first()["records"] == 4
    back, left = delivery.requeue(store_.rejected(), "b1")
    assert (back.count(), left.count()) == (4, 0)
    assert delivery.discard(store_.rejected(), "b1")[1] == 4
    assert store.purge_quarantine(store_.rejected(), "h").count() == 0
    assert delivery.flush(store_, out.state, Scripted(OK), NOW, force=True).outcome == "empty"


def test_unreadable_rows_are_set_aside(spark, folders):
    store_, sink = spool(spark, folders(), broken=(1,)), Scripted(OK)
    out = delivery.flush(store_, delivery.State(), sink, NOW, force=True)
    assert (out.outcome, out.records, out.unreadable) == ("uploaded", 3, 1)
    assert [(r["request_id"], r["details"]) for r in store_.rejected().collect()] == [("r1", "invalid JSON")]
    back, left = delivery.requeue(store_.rejected(), store_.rejected().first()["batch_id"])
    assert (back.count(), left.count()) == (0, 1)
    store_, sink = spool(spark, folders(), broken=(0, 1, 2, 3)), Scripted(OK)
    out = delivery.flush(store_, delivery.State(), sink, NOW, force=True)
    assert (out.outcome, out.unreadable, sink.seen, out.state.pending, store_.rejected().count()) == ("empty", 4, [], (), 4)


class Crash(Exception):
    pass


@pytest.mark.parametrize(("answer", "broken", "first"), [(OK, (2,), 0), (delivery.Response(400), (), 3)])
def test_a_flush_can_be_cut_short_anywhere(spark, folders, answer, broken, first):
    """After a crash before any step, and a repetition, every record is delivered once or set aside, under one id."""
    for at in itertools.count(first):
        path = folders()
        store_, state_path, sink, ids, calls = spool(spark, path, 2 + len(broken), broken), f"{path}.json", Scripted(answer), itertools.count(), itertools.count()

        def step(f, calls=calls, at=at):
            def run(*args):
                if next(calls) == at:
                    raise Crash
                return f(*args)

            return run

        wrapped = source.TableSpool(spark, path)
        for name in ("remove", "set_aside", "pin", "settle"):
            setattr(wrapped, name, step(getattr(wrapped, name)))
        sending = Scripted(answer)
        sending.seen, sending.deliver = sink.seen, step(sending.deliver)
        options = {"force": True, "new_id": lambda ids=ids: f"b{next(ids)}"}
        save = step(DeliveryLog(spark, state_path).save)
        try:
            delivery.flush(wrapped, delivery.State(), sending, NOW, save=save, **options)
            crashed = False
        except Crash:
            crashed = True
        log = DeliveryLog(spark, state_path)
        out = delivery.flush(store_, log.load(), sink, NOW, save=log.save, **options)
        assert store_.rows().count() == 0 and out.state.pending == ()
        aside = sorted(r["request_id"] for r in store_.rejected().collect())
        if answer is OK:
            assert aside == [f"r{i}" for i in broken]
            assert {n for _, n in sink.seen} == {2} and len({b for b, _ in sink.seen}) == 1
        else:
            assert sorted(set(aside)) == [f"r{i}" for i in range(2 + len(broken))]
        if not crashed:
            break


def test_writes_after_a_removal_stay(spark, folders):
    path = folders()
    store_ = spool(spark, path)
    store_.remove(store_.rows())
    assert store_.rows().count() == 0
    source.write_records(spool_rows(spark, 2), path, 1)
    source.write_records(spool_rows(spark, 1), path, 1)  # a repeated write replaces all of what it wrote
    assert [r["request_id"] for r in store_.rows().collect()] == ["r0"]
    again = spool_rows(spark, 1).withColumns({"timestamp": F.lit("2024-01-01T00:00:00Z"), "session_key": F.lit("later")})
    source.write_records(again.withColumn("data", F.lit("{}")), path, 2)
    assert [(r["data"], r["size"]) for r in store_.rows().collect()] == [("{}", 2)]
    index = store.latest_index(source.read_index(spark, path)).where("request_id = 'r0'").collect()
    assert [r["session_key"] for r in index] == ["later"]


def test_delivery_log(spark, tmp_path):
    log, other = (DeliveryLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert log.load() == other.load() == delivery.State()
    state = delivery.State(pending=("b",), receipt={"batch_id": "a", "records": 1, "bytes": 9, "at": 3.0})
    log.save(state)
    assert DeliveryLog(spark, log.path).load() == state
    with pytest.raises(Fenced):  # the other has not seen that
        other.save(delivery.State(pending=("c",)))
    assert other.load() == state
    other.save(replace(state, last_error="status 400", last_rejected="b: 3 records"))
    with pytest.raises(Fenced):
        log.save(state)
    log.load()
    log.save(replace(state, receipt={"batch_id": "d", "records": 2, "bytes": 8, "at": 4.0}))
    want = [(1, "receipt", "a", 1, 9), (2, "error", None, None, None), (2, "rejection", "b", None, None), (3, "receipt", "d", 2, 8)]
    facts = lambda: sorted(tuple(r)[:5] for r in log.history().collect())
    assert facts() == want
    log.roll(keep=1)
    assert log.log.numbers() == [3] and facts() == want
    (tmp_path / "log/entries/000000000004.json").write_text("{")
    assert log.load().receipt["batch_id"] == "d"
    assert os.path.exists(tmp_path / "log/entries/000000000004.json.unreadable")
    log.save(delivery.State())
    assert DeliveryLog(spark, log.path).load() == delivery.State()


def test_exit_flush(spark, folders, tmp_path):
    """A stream that is stopped is followed by one flush within its budget, and by none after that."""
    store_, sink, log = spool(spark, folders()), Scripted(OK), DeliveryLog(spark, f"file://{tmp_path}/log")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    watcher = capture.ExitFlush(store_, log, sink, lambda: NOW + 90_000, "1")
    query = watcher.watch(spark, capture.flush_stream(ticks, store_, log, sink, lambda: NOW, str(tmp_path / "ck"), "1", {"processingTime": "1 hour"}).start())
    query.stop()
    assert watcher.done.wait(60)
    spark.streams.removeListener(watcher)
    assert (watcher.reply.outcome, watcher.reply.records, store_.rows().count(), log.load().closed) == ("uploaded", 4, 0, True)
    assert delivery.flush(store_, log.load(), sink, NOW, force=True).error == "closed"
    assert delivery.close(store_, log.load(), sink, NOW).error == "closed"


def test_lost_pending_is_cleared(spark, folders):
    store_ = spool(spark, folders())
    out = delivery.flush(store_, delivery.State(pending=("gone",)), Scripted(OK), NOW)
    assert (out.outcome, out.state.pending) == ("below_threshold", ())
    closed = delivery.close(store_, delivery.State(), Scripted(OK), NOW).state
    assert delivery.flush(store_, closed, Scripted(OK), NOW, force=True).error == "closed"


def test_flush_stream(spark, folders, tmp_path):
    path = folders()
    store_, sink, log = spool(spark, path, broken=(3,)), Scripted(delivery.Response(400), OK), DeliveryLog(spark, f"file://{tmp_path}/state")
    spark.range(1).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    run = lambda: capture.flush_stream(ticks, store_, log, sink, lambda: NOW + 90_000, str(tmp_path / f"ck{next(count)}"), "1", {"availableNow": True}).start().awaitTermination(120)
    count = itertools.count()
    run()
    assert (store_.rows().count(), store_.rejected().count()) == (0, 4)
    source.write_records(spool_rows(spark, 2), path, 1)
    run()
    state = DeliveryLog(spark, log.path).load()
    assert (store_.rows().count(), store_.rejected().count(), state.pending, state.receipt["records"]) == (0, 4, (), 2)


def test_store_scan(spark, tmp_path):
    assert source.scan_store(spark, str(tmp_path / "none")).count() == 0
    day = tmp_path / "20240506"
    day.mkdir()
    (day / "r1.json").write_text('{"a":1}')
    (day / "note.txt").write_text("x")
    (day / "index.jsonl").write_text('{"request_id":"r1","session_key":"s1","timestamp":"2024-05-06T00:00:00Z"}\nbroken\n{"request_id":"r1","session_key":"s2"}\n')
    files, index = source.scan_store(spark, str(tmp_path)), source.scan_index(spark, str(tmp_path))
    assert [tuple(r) for r in files.select("day", "request_id", "data", "size").collect()] == [("20240506", "r1", '{"a":1}', 7)]
    assert sorted(r["parse_ok"] for r in index.collect()) == [False, True, True]
    assert store.with_index(files, index).first()["session_key"] == "s2"
    kept = store.rewrite_index(index, files.select("day", "request_id"))
    assert [r["parse_ok"] for r in kept.collect()] == [False]


def test_config_chain(spark, tmp_path):
    (tmp_path / "strong.json").write_text('{"flush_bytes": 7,\n "notice": null}')
    (tmp_path / "weak.json").write_text('{"flush_bytes": 9, "notice": "n"}')
    chain = source.read_config_chain(spark, [str(tmp_path / f"{n}.json") for n in ("strong", "missing", "weak")], "flush_bytes long, notice string")
    assert [tuple(r) for r in chain.orderBy("place").collect()] == [(7, None, 0), (9, "n", 2)]
    by = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in ("flush_bytes", "notice")}
    assert tuple(chain.agg(*by.values()).first()) == (7, "n")
    assert source.read_config_chain(spark, [str(tmp_path / "missing.json")], "notice string").count() == 0


def test_index_of_many_blocks(spark, tmp_path):
    day = tmp_path / "20240506"
    day.mkdir()
    lines = [json.dumps({"request_id": f"r{i % 50}", "session_key": f"s{i}"}) for i in range(60_000)]
    (day / "index.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        index = source.scan_index(spark, str(tmp_path))
        assert index.rdd.getNumPartitions() > 4
        got = {r["request_id"]: r["session_key"] for r in store.latest_index(index).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"r{i % 50}": f"s{i}" for i in range(59_950, 60_000)}


def test_record_stream(spark, tmp_path):
    routes = tmp_path / "routes"
    spark.createDataFrame([("t1", "h1", "/a", "https://a", "g", "")], capture.ROUTES).write.json(str(routes))
    rows = frame(spark, exchange(), exchange(response=b'{"id":"m2"}')).drop("project_id_hash").withColumns({"token": F.lit("t1"), "method": F.lit("POST"), "path": F.lit("/v1/messages")})
    rows = rows.union(rows.withColumn("token", F.lit("t9")))
    rows.write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(checkpoint):
        capture.record_stream(incoming, str(routes), str(tmp_path / "store"), str(tmp_path / checkpoint), "1", trigger={"availableNow": True}).start().awaitTermination(120)
        return sorted(r["request_id"] for r in source.read_records(spark, str(tmp_path / "store")).collect())

    assert run("ck") == ["m1", "m2"]
    assert source.read_index(spark, str(tmp_path / "store")).count() == 2
    spark.createDataFrame([("t1", "h1", "/a", "https://a", "g", "revoked")], capture.ROUTES).write.mode("overwrite").json(str(routes))
    assert run("ck2") == []  # the same micro-batch again, after consent was withdrawn
    assert capture.fresh_routes(spark, str(tmp_path / "missing")).count() == 0


def streamed(spark, folder, parts, **options):
    """Rows of a stream that gets the parts as micro-batches."""
    schema = "exchange_id string, seq long, name string, data string"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        incoming = capture.assemble_events(spark.readStream.schema(schema).parquet(f"{folder}/in"), **options)
        writer = incoming.writeStream.foreachBatch(lambda df, n, i=i: df.write.mode("append").parquet(f"{folder}/out")).outputMode("append")
        query = writer.option("checkpointLocation", f"{folder}/ck").start()
        # such a query goes on without data, for its timeouts: it is stopped two batches after the last rows
        seen, end = 0, time.time() + 90
        while time.time() < end and (seen == 0 or query.lastProgress["batchId"] < seen + 2):
            time.sleep(0.2)
            seen = max([seen, *(p["batchId"] + 1 for p in query.recentProgress if p["numInputRows"])])
        query.stop()
    return {r["exchange_id"]: (r["message"], r["error"]) for r in spark.read.parquet(f"{folder}/out").collect()}


DELTA = ("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": "a<b"}})
BLOCK, BLOCK_STOP = ("content_block_start", {"index": 0, "content_block": {"type": "text", "text": "9"}}), ("content_block_stop", {"index": 0})


def numbered_events(who, *events):
    return [(who, i, n, json.dumps(d)) for i, (n, d) in enumerate(events)]


def test_event_stream(spark, tmp_path):
    rows = numbered_events("x1", START, STOP) + numbered_events("x2", ("ping", {}), STOP) + numbered_events("x3", START, BLOCK, DELTA, DELTA, BLOCK_STOP, STOP) + numbered_events("x4", START)
    early = [r for r in rows if r[1] < 3]
    late = [r for r in rows if r[1] >= 3] + [("x1", 2, "message_stop", "{}")]
    got = streamed(spark, str(tmp_path), [early, late])
    assert {k: (v[0] is not None, v[1]) for k, v in got.items()} == {"x1": (True, None), "x2": (False, "event before start"), "x3": (True, None)}
    whole = {r["exchange_id"]: (r["message"], r["error"]) for r in capture.assemble_whole(spark.createDataFrame(rows, "exchange_id string, seq long, name string, data string")).collect()}
    assert got["x3"] == whole["x3"] and whole["x4"] == (None, "no stop")
    assert json.loads(whole["x3"][0])["content"] == [{"type": "text", "text": "9a<ba<b"}]


def test_events_in_any_order(spark, tmp_path):
    """Events that are dealt to micro-batches at random give the rows that they give at once."""
    rng, rows = random.Random(5), []
    for i in range(25):
        deltas = [("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": f"{k},"}}) for k in range(rng.randint(0, 6))]
        rows += numbered_events(f"x{i}", START, *([BLOCK] if i % 5 else []), *deltas, BLOCK_STOP, STOP)
    rows = [r for r in rows if r[:2] != ("x7", 2)]  # an event that never comes
    parts = [[], [], [], []]
    for r in rows:
        for part in rng.sample(parts, rng.choice([1, 1, 2])):  # some come twice
            part.append(r)
    for part in parts:
        rng.shuffle(part)
    got = streamed(spark, str(tmp_path), parts)
    whole = capture.assemble_whole(spark.createDataFrame(rows, "exchange_id string, seq long, name string, data string"))
    assert got == {r["exchange_id"]: (r["message"], r["error"]) for r in whole.collect() if r["exchange_id"] != "x7"}


def test_whole_exchanges_are_taken_in_order_without_a_table_each(spark):
    """Many short exchanges share a task's batches, and one lies in many of them."""
    rows = [r for i in range(40) for r in numbered_events(f"x{i}", START, STOP)]
    rows += numbered_events("long", START, *[BLOCK] * 30, STOP) + numbered_events(None, START) + [("gap", 5, "ping", "{}")]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        whole = capture.assemble_whole(spark.createDataFrame(rows, "exchange_id string, seq long, name string, data string"))
        got = {r["exchange_id"]: (r["message"], r["error"]) for r in whole.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ordered = lambda key: sorted((r[1:] for r in rows if r[0] == key), key=lambda r: r[0])
    assert got == {key: capture.message_of(r[1:] for r in ordered(key)) for key in {r[0] for r in rows}}
    assert got["gap"] == (None, "event before start") and got[None] == (None, "no stop") and got["x7"][1] is None
    assert "InPandas" not in whole._jdf.queryExecution().toString()


def test_silent_exchanges_are_given_up(spark, tmp_path):
    rows = numbered_events("x1", START) + [r for r in numbered_events("x2", START, BLOCK, STOP) if r[1] != 1]
    got = streamed(spark, str(tmp_path), [rows, numbered_events("x3", START, STOP)], silence_ms=1)
    assert got["x1"] == (None, "no stop") and got["x2"] == (None, "missing events") and got["x3"][1] is None


def test_findings(spark):
    devices = spark.createDataFrame([
        ("a", 5, 10, None, None, None, None, None), ("b", 10, 10, "", "2.0.0", "1.0.0", "upgrade", "hi"), ("c", None, None, "no room", "x", "1.0.0", "", ""),
    ], "device string, usage long, quota long, write_error string, min_client_version string, version string, upgrade_message string, notice string")
    rejected = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", "y"), ("z", "q")], "device string, batch_id string")
    rows = sorted(map(tuple, reports.findings(devices, rejected).collect()))
    assert rows == [
        ("a", "quarantine", "ok", "empty"), ("a", "store", "ok", "takes writes, 5 B of 10 B used"), ("b", "quarantine", "problem", "2 batches set aside"), ("b", "service", "note", "notice: hi"),
        ("b", "service", "note", "says: upgrade"), ("b", "service", "note", "wants version 2.0.0 or newer, this is 1.0.0"), ("b", "store", "problem", "full, 10 B of 10 B used"), ("c", "quarantine", "ok", "empty"),
        ("c", "service", "note", "wants version x or newer, this is 1.0.0"), ("c", "store", "problem", "takes no writes: no room, 0 B used"),
    ]
    assert {(r["severity"], r["n"]) for r in reports.severity_counts(reports.findings(devices, rejected)).collect()} == {("ok", 3), ("problem", 3), ("note", 4)}
    assert reports.findings(devices.limit(0), rejected).count() == 0
