"""Row rules, keys, segments, status alerts, chat files and stores on typed cases."""

import datetime as dt
import random
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import ids
from bazaarlens.operators import chat_export, chunked, reports, screening, segments
from bazaarlens.sources import files, sinks


def test_keys(spark):
    keys = F.array(*[F.lit(k) for k in ("K3", "K1", "K2", "K1")])
    row = spark.range(1).select(
        ids.idempotency_key(F.lit("whatsapp"), F.lit("g"), keys).alias("idem"),
        ids.sender_ref(F.lit(" Some:12@Net "), "secret").alias("ref"), ids.chat_ref(F.lit("some@net"), "k" * 90).alias("c"),
        ids.hamming64(F.lit(-1), F.lit(3)).alias("d")).first()
    assert row.idem == hashlib.sha256(b"whatsapp\ng\nK1\nK2\nK3").hexdigest()
    assert row.ref == hmac.new(b"secret", b"s:some@net", hashlib.sha256).hexdigest()[:32]
    assert row.c == hmac.new(b"k" * 90, b"c:some@net", hashlib.sha256).hexdigest()[:32]
    assert row.d == 62
    with pytest.raises(ValueError):
        ids.sender_ref(F.lit("x"), "")


def test_decisions(spark):
    full = ("Nike", "EU 42", 4500, False)
    cases = [(full, "repost", "auto", "ollama", "repost", ""), (full, "multi_item", "never", "ollama", "policy", ""),
             ((None, None, None, False), "", "auto", "off", "policy", ""), (full, "no_shoe", "auto", "x", "no_shoe", ""),
             (full, "multi_item", "auto", "x", "multi_item", ""), (full, "", "auto", "x", "local_sufficient", ""),
             (("Nike", None, None, False), "multi_item", "auto", "x", "multi_item", "size,price"),
             (("Nike", "EU 42", None, False), "", "auto", "x", "missing:price", "price"),
             (("Nike", "EU 42", None, True), "", "auto", "x", "local_sufficient", ""),
             ((None, None, None, False), "", "auto", "x", "missing:brand,size,price", "brand,size,price")]
    rows = [(i, *c[0], c[1], c[2], c[3]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, brand string, size_label string, price int, price_on_request boolean, flag "
                                     "string, policy string, provider string")
    df = df.withColumns({f: F.col("flag") == f for f in ("repost", "no_shoe", "multi_item")})
    got = screening.needs_enrichment(df, policy=F.col("policy"), provider=F.col("provider")).orderBy("i").collect()
    assert [(g.reason, ",".join(g.missing)) for g in got] == [c[4:] for c in cases]


def test_secrets_and_media(spark):
    df = spark.createDataFrame([(1, "see token=abcdefghijklmnopqrstuvwx"), (2, "ab hf_ABCDEFGHIJKLMNOPQRSTUV"),
                                (3, "x +92 300 1234567"), (4, "v1.23456789012"), (5, "plain")], "id int, t string")
    got = {(r.id, r.finding, r.at) for r in screening.secret_scan(df, "id", "t").collect()}
    assert got == {(1, "credential", 4), (2, "service_token", 3), (3, "phone", 2)}
    heads = [(b"\xff\xd8\xff\xe0rest", None), (b"\x89PNG\r\n\x1a\nrest", None), (b"RIFF1234WEBPrest", None),
             (b"RIFF1234WAVErest", "bad_type"), (b"GIF89a", "bad_type"), (b"\xff\xd8\xff" + b"x" * 100, "too_large")]
    blobs = spark.createDataFrame([(i, bytearray(h)) for i, (h, _) in enumerate(heads)], "i int, c binary")
    verdict = screening.media_verdict(F.col("c"), F.octet_length("c"), max_bytes=50)
    assert [r.v for r in blobs.select("i", verdict.alias("v")).orderBy("i").collect()] == [w for _, w in heads]


SEGMENTS = {  # captions in order, "-" none, "!" without media, T = text; expected segments and extra text
    "first": ("Nike 42,-,-", {"Nike 42": 3}, ""), "last": ("-,-,Nike 42", {"Nike 42": 3}, ""),
    "none": ("-,-", {None: 2}, ""), "three": ("Nike 42,Vans 40,Puma 41", {"Nike 42": 1, "Vans 40": 1, "Puma 41": 1}, ""),
    "equal": ("Nike 42,nike  42,NIKE 42", {"Nike 42": 3}, ""), "between": ("-,Nike 42,-,Vans 40,-", {"Nike 42": 3,
                                                                                                "Vans 40": 2}, ""),
    "emoji": ("🔥🔥,Nike 42", {"Nike 42": 2}, ""), "text": ("TPrice 4500,-,-,T  dm  ", {None: 2}, "Price 4500\ndm"),
    "lost media": ("Nike 42!,-,Vans 40,-", {"Nike 42": 1, "Vans 40": 2}, ""),
    "lost run": ("Nike 42!,Vans 40,-", {"Vans 40": 2}, "Nike 42"),
}


def test_segments(spark):
    rows = []
    for p, (text, _, _) in enumerate(SEGMENTS.values()):
        for seq, word in enumerate(text.split(",")):
            kind = "text" if word.startswith("T") else "image"
            caption = None if word == "-" else word.lstrip("T").rstrip("!") if kind == "text" else word.rstrip("!")
            photo = 100 + seq if kind == "image" and not word.endswith("!") else None
            rows.append((p, seq, kind, caption, photo))
    msgs = spark.createDataFrame(rows[::-1], "post_id long, seq long, kind string, caption string, image_id long")
    line = chunked.Line(["post_id"], [F.col("seq")], F.floor(F.col("seq") / 2))
    got = {}
    for r in segments.segment_posts(msgs, line).orderBy("post_id", "seq").collect():
        per = got.setdefault(r.post_id, {})
        assert r.segment_idx == (list(per).index(r.segment_caption) if r.segment_caption in per else len(per))
        per[r.segment_caption] = per.get(r.segment_caption, 0) + 1
    assert got == {p: want for p, (_, want, _) in enumerate(SEGMENTS.values())}
    extra = {r.post_id: r.extra_text for r in segments.post_extra_text(msgs, line).collect()}
    assert extra == {p: e for p, (_, _, e) in enumerate(SEGMENTS.values()) if e}


def test_alerts(spark):
    states = ["open", "logged_out", "logged_out", "open", "logged_out", "stopped:shutdown", "replaced", "logged_out"]
    rows = [("s", i, s.partition(":")[0], s.partition(":")[2] or None) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "source string, i long, state string, detail string")
    line = chunked.Line(["source"], [F.col("i")], F.floor(F.col("i") / 2))
    assert sorted(r.i for r in reports.state_alerts(df, line).collect()) == [1, 4, 6, 7]


def test_admission_over_days(spark):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(i, 1, 0, at + dt.timedelta(hours=5 * i), "ok" if i != 2 else "http_error") for i in range(8)]
    df = spark.createDataFrame(rows, "call_id long, post_id long, segment_idx int, ts timestamp, status string").withColumn(
        "day", F.to_date("ts"))
    got = reports.admit_calls(df, [F.col("ts")], day_cap=2, segment_cap=4).orderBy("call_id").collect()
    # day 1: two units, the error is free but asked after the cap; day 2: two more units, then the segment is used up
    assert [g.decision for g in got] == ["admitted", "admitted", "DAY_CAP", "admitted", "admitted", "DAY_CAP", "DAY_CAP",
                                         "DAY_CAP"]


@pytest.mark.parametrize("day_cap, segment_cap", [(6, 9), (100, 5), (3, 100), (0, 4)])
def test_admission_against_one_by_one(spark, day_cap, segment_cap):
    rng, at, rows = random.Random(day_cap), dt.datetime(2024, 1, 1), []
    for i in range(400):
        at += dt.timedelta(minutes=rng.choice([0, 40, 200]))
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), 0, at, rng.choice(["ok", "ok", "timeout", "http_error"])))
    df = spark.createDataFrame(rows, "call_id long, post_id long, segment_idx int, ts timestamp, status string").withColumn(
        "day", F.to_date("ts"))
    want, spent, used = [], {}, {}
    for _, post, _, ts, status in rows:
        day, billed = ts.date(), status != "http_error"
        verdict = ("DAY_CAP" if spent.get(day, 0) >= day_cap else "POST_CAP" if used.get(post, 0) >= segment_cap else "admitted")
        if verdict == "admitted" and billed:
            spent[day], used[post] = spent.get(day, 0) + 1, used.get(post, 0) + 1
        want.append(verdict)
    got = reports.admit_calls(df, [F.col("ts"), F.col("call_id")], day_cap=day_cap, segment_cap=segment_cap)
    assert [r.decision for r in got.orderBy("call_id").collect()] == want


CHAT = ("﻿14/03/24, 13:00 - Messages are encrypted.\nstill the notice\n14/03/24, 13:00 - One: IMG-1.jpg (file "
        "attached)\r\nNike AF1 size 42 Rs 4500\n14/03/24, 13:00 - One: same\n14/03/24, 13:00 - One: same\n"
        "14/03/24, 13:01 - +92 300 1234567: hello <This message was edited>\n"
        "14/03/24, 13:02 - Two: <Media omitted>\n14/03/24, 13:03 - Two: VID-2.mp4 (file attached)\n")


def test_chat_file(spark, tmp_path):
    (tmp_path / "chat.txt").write_bytes(CHAT.encode())
    (tmp_path / "other.txt").write_text("01/02/24, 13:00 - A: x\n03/04/24, 13:00 - A: y")
    lines = files.read_chat_lines(spark, str(tmp_path))
    chat = lines.where(F.col("file").endswith("chat.txt")).orderBy("line_no").collect()
    assert [r.line_no for r in chat] == list(range(10)) and chat[-1].line == ""
    assert chat[0].line.startswith("14/03") and chat[2].line.endswith("attached)")
    assert lines.where(F.col("file").endswith("other.txt")).count() == 2
    heads = chat_export.parse_chat_headers(lines)
    formats = {r.file.rsplit("/")[-1]: (r.kind, r.date_order, r.problem) for r in
               chat_export.infer_chat_format(heads).collect()}
    assert formats == {"chat.txt": ("android", "dmy", None), "other.txt": ("android", None, "needs_date_order")}
    msgs = chat_export.assemble_messages(heads, chat_export.infer_chat_format(heads), "Asia/Karachi")
    media = spark.createDataFrame([("IMG-1.jpg", 10)], "name string, length long")
    rows = chat_export.build_messages(chat_export.classify_body(msgs, media), F.lit("g")).orderBy("line_no").collect()
    assert [(r.kind, r.caption, r.missing) for r in rows] == [
        ("image", "Nike AF1 size 42 Rs 4500", False), ("text", "same", False), ("text", "same", False),
        ("text", "hello", False)]
    assert len({r.key for r in rows}) == 4 and all(r.key.startswith("exp:") and len(r.key) == 36 for r in rows)
    assert rows[3].sender == "923001234567@s.whatsapp.net" and rows[0].sender == "name:One"
    assert rows[0].ts_s == dt.datetime(2024, 3, 14, 8, 0, tzinfo=dt.timezone.utc).timestamp()


def test_clock_forms(spark):
    cases = [("3/14/24", "1:05:09 PM", "mdy"), ("14.03.24", "13:05:09", "dmy"), ("2024-03-14", "13.05.09", "ymd"),
             ("14/03/2024", "1:05:09 p.m.", "dmy")]
    df = spark.createDataFrame(cases, "d string, c string, o string")
    got = df.select(chat_export.parse_chat_ts(F.col("d"), F.col("c"), F.col("o"), "UTC").alias("t")).collect()
    assert {r.t for r in got} == {dt.datetime(2024, 3, 14, 13, 5, 9)}


def test_store_rules(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2)], "k int, v string, at int")
    merged = {r.k: r.v for r in sinks.upsert(stored, new, ["k"], [F.col("at")]).collect()}
    assert merged == {1: "a", 2: "d", 3: "f"}
    assert [(r.k, r.v) for r in sinks.insert_ignore(stored, new, ["k"], [F.col("at")]).collect()] == [(3, "e")]
