"""WARC transactions, chat formatting, the registered queries' SQL, and the pipeline."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gossamer.llm import chat, decontaminate, jaccard, queries, quality, tokenbin, warc
from gossamer.session import materialize, table

SF = "/root/testdata/sf0.001"


# -- 1: WARC --------------------------------------------------------------------------------------


def captures(spark, pages, path):
    warc.write_archives(pages, path)
    return warc.assemble(materialize(warc.read_archives(spark, path), "t"))


def test_warc_odd_pages(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (4, "http://a/4\r\nX: y", ""), (-5, "http://é/ü", trap), (6, "http://a/6", "é" * 100_000), (None, "http://n", "same"), (7, "http://a/7", "same"), (7, "http://a/7", "same"), (8, "http://a/8", "\n\n")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, key string")
    got = {}
    for r in captures(spark, pages, f"file://{tmp_path}/w").collect():
        p = r["response"]
        page = spark.range(1).select(warc.page_of(F.lit(p["record_id"])), warc.page_of(F.lit(p["refers_to"]))).first()
        assert len(r["requests"]) == 1 and len(r["metadata"]) >= 1 and r["part"] == 0
        got[page[0]] = (p["record_type"], page[1], p["payload_digest"], p["declared_bytes"], bytes(p["payload"]).decode() if p["record_type"] == "response" else None)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, _, html in rows:
        kind, ref, d, n, body = got[i]
        assert d == digest(html) and n == len((html or "").encode())
        first = {"same": 1, None: 2, "": 2}.get(html)
        assert (kind, ref) == (("response", None) if first in (None, i) else ("revisit", first))
        assert kind == "revisit" or body == (html or "")
    assert len(got) == 9  # the repeated row is one capture
    records = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    responses = {r["record_id"] for r in records if r["record_type"] == "response"}
    assert all(r["refers_to"] in responses for r in records if r["record_type"] == "revisit")
    copies = [r["n_copies"] for r in warc.assemble(materialize(warc.read_archives(spark, f"file://{tmp_path}/w"), "t")).where("response is not null").collect()]
    assert sorted(copies) == [1] * 8 + [2]


def test_warc_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert captures(spark, pages, f"file://{tmp_path}/w").count() == 0


def test_warc_parser_reads_members_and_lower_case_headers():
    rec = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for raw in (rec * 2, gzip.compress(rec) + gzip.compress(rec), gzip.compress(rec * 2)):
        got = list(warc.parse_warc(raw))
        assert len(got) == 2 and got[0]["concurrent_to"] == ["<a>", "<b>"] and got[1]["payload"] == b"hello" and got[0]["record_type"] == "resource"
    assert list(warc.parse_warc(b"")) == [] and list(warc.parse_warc(b"junk")) == []


def test_assembly_follows_links_both_ways(spark):
    rec = lambda i, kind, to: (i, kind, to, None, None, None, None, 0, None)
    rows = [rec("r1", "response", ["q1"]), rec("q1", "request", []), rec("m1", "metadata", ["q1"]), rec("r2", "revisit", []), rec("q2", "request", ["r2"]), rec("m2", "metadata", ["r2"]), rec("lost", "request", ["gone"]), rec(None, "metadata", [])]
    rows += [rec(f"x{i}", "metadata", ["r2"]) for i in range(2500)]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORDS_DDL)).collect()
    ids = lambda rs: sorted(x["record_id"] or "" for x in rs)
    one = next(r for r in got if r["response"] and r["response"]["record_id"] == "r1")
    assert ids(one["requests"]) == ["q1"] and ids(one["metadata"]) == ["m1"]
    two = [r for r in got if r["capture_id"] == "r2"]
    assert len(two) > 1 and sum(len(r["metadata"]) for r in two) == 2501 and all(len(r["metadata"]) < 2000 for r in two) and sum(r["response"] is not None for r in two) == 1
    assert [ids(r["requests"]) for r in got if r["capture_id"] == "lost"] == [["lost"]] and sum(r["n_records"] for r in got) == len(rows)


# -- 6: chats -------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\n", "<|seg|>", "a\\", "<s><s>", "", None, "[/INST", "<\\/s>", "é\n" * 3, "x" * 100_000]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, None, "a"), (2, None, "user", "first"), (2, 0, None, "a"), (None, 5, "[INST]", "z"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["parsed"]] for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert got[1] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[2] == [("user", "first"), ("", "a"), ("", "a")] and got[None] == [("[INST]", "z")] and got[3] == [("assistant", "a"), ("assistant", "b")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_adjacent_turns_share_a_header(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c")])], "conv_id long, turn long, role string, text string")
    text = chat.format_chats(df).first()["formatted"]
    assert text == "<s>[INST]user[/INST]a<|seg|>b</s><s>[INST]assistant[/INST]c</s>"


def test_loss_mask_covers_the_assistants_texts(spark):
    rows = [(1, 0, "user", "é[INST]"), (1, 1, "assistant", "ü </s>\\"), (1, 2, "assistant", ""), (1, 3, "assistant", "b"), (1, 4, "user", "<s>"), (2, 0, "user", None), (3, None, "assistant", "<|seg|>中"), (None, 1, None, "x")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_spans string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    for key in {r[0] for r in rows}:
        raw = got[key].formatted.encode()
        texts = [re.sub(r"(?s)\\(.)", r"\1", raw[s.start : s.start + s.length].decode()) for s in got[key].loss_spans]
        assert texts == [r[3] for r in rows if r[0] == key and r[2] == "assistant"]
    users = chat.format_chats(df, loss_role="user").where("conv_id = 1").first()
    assert len(users.loss_spans) == 2


@pytest.mark.parametrize("turns", [20_000, 20_001])
def test_long_conversations_take_time_that_follows_their_length(spark, turns):
    import time

    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant") if turns % 2 else F.lit("assistant")
    df = spark.range(turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("some words [INST]").alias("text"))
    began = time.time()
    r = chat.format_chats(df).select(F.size("loss_spans"), F.octet_length("formatted")).first()
    assert r[0] == (turns // 2 if turns % 2 else turns) and time.time() - began < 15


# -- SQL ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    import parity

    con = parity.connect(SF)
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert parity.norm([tuple(r) for r in df.collect()], df.columns) == parity.norm(cur.fetchall(), cols)


# -- the pipeline ---------------------------------------------------------------------------------


def test_stages_do_their_work(spark):
    docs = table(spark, SF, "documents")
    seen = docs.toPandas().set_index("doc_id")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append(docs.toPandas().set_index("doc_id"))
    good, single, clean, mixed = steps
    # 1: what a model fitted in the plain way rejects goes
    stats = quality.features(table(spark, SF, "documents"))
    model = quality.fit_quality(stats, table(spark, SF, "labels"))
    scores = {r["id"]: r["score"] for r in quality.score_stats(stats, model).collect()}
    assert set(good.index) == {i for i, s in scores.items() if s >= quality.THRESHOLD} and len(good) > len(seen) / 2
    # 2: the smallest of each class by brute force stays
    sets = {}
    for i, t in good.text.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(single.index) == {i for i in ids if find(i) == i} and len(single) < len(good)
    # 3: no text that holds an item stays, and no other goes
    items = [decontaminate.normalise(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    holds = {i for i, t in single.text.items() if any(x in decontaminate.normalise(t) for x in items)}
    assert holds and not holds & set(clean.index) and len(set(single.index) - set(clean.index) - holds) <= 2
    # 4: texts stay as they are
    assert set(mixed.index) <= set(clean.index) and 0.6 < len(mixed) / len(clean) <= 1 and (mixed.text == clean.text.loc[mixed.index]).all()
    # 5: files hold what is left, in order
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas().sort_values("doc_id")
    assert out.doc_id.tolist() == sorted(mixed.index) and (out.start.to_numpy()[1:] == out.n_tokens.cumsum().to_numpy()[:-1]).all()
    enc = tokenbin.encoder(tokenbin.default_tokenizer())
    assert out.n_tokens.tolist() == [len(c) // 4 for c in enc.encode(mixed.text.sort_index().tolist(), 2)]
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in out.itertuples(index=False)}


def test_stages_take_odd_tables(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, rate double, topic string, quality_score double, _quality_score int, _hits_0 string, benchmark_hits int, `a.b` string, gone_id long, row string, c0 int"
    more = (0.5, 1, "h", 2, "dot", 3, "r", 4)
    docs = spark.createDataFrame([(1, "a b c d e f", None, "s", 1, 1.0, "t", *more), (1, "a b c d e f", None, "s", 1, 1.0, "t", *more), (None,) * 15, (2, "", "en", None, 0, 0.0, "u", *more), (3, "w " * 100_000, "en", "s", 0, 0.0, "u", *more)], ddl)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count() and (name == "token files" or out.columns == docs.columns)
            assert name == "token files" or all(r["a.b"] in (None, "dot") for r in out.collect())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == {1: 1, None: 1, 2: 1, 3: 1}
    assert jaccard.jaccard_classes(docs).count() == 5


def test_rows_of_one_id_leave_the_smallest_text(spark):
    rows = [(7, "second text of the id", "en"), (7, "first text of the id", "fr"), (7, "first text of the id", "de"), (8, "words that nobody else has", "en")]
    got = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got.add(frozenset(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()))
    assert len(got) == 1 and {r[:2] for r in next(iter(got))} == {(7, "first text of the id"), (8, "words that nobody else has")}


def test_mixing_keeps_columns_of_any_name(spark):
    from gossamer.llm import mixing

    rows = [(i, f"s{i % 3}", "en", "prose", 10, 0.25, "k", "l", "m") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long, _mix_rate double, _k_lang string, _mix_lang string, __mix_topic string")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "rate", "kept"]
    assert sorted(tuple(r)[:9] for r in out.collect()) == rows


def test_archives_and_token_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_PAGES", 10)
    monkeypatch.setattr(tokenbin, "FILE_SHARDS", 1)
    pages = spark.range(35).select(F.col("id").alias("page_id"), F.lit("http://e/").alias("url"), F.concat(F.lit("<p>"), F.col("id")).alias("html"))
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    assert sum(1 for _ in (tmp_path / "w").glob("part-*")) >= 4
    assert warc.read_archives(spark, folder).where("record_type = 'response'").count() == 35
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text")).coalesce(1)
    folder = f"file://{tmp_path}/t"
    tokenbin.write_tokens(docs, folder, tokenbin.default_tokenizer(), 2, shard_ids=20)
    files = [f.read_bytes() for f in (tmp_path / "t").glob("part-*")]
    assert files and all(len(list(tokenbin.shards(f))) == 1 for f in files if f)
    got = tokenbin.with_starts(tokenbin.read_tokens(spark, folder)).orderBy("doc_id").collect()
    assert [r.start for r in got] == [k * got[0].n_tokens for k in range(40)]
