"""Archives and chat formatting by exact round trips; the pipeline stage by stage against brute force."""

import base64
import hashlib
import random
import struct

import pytest
import zstandard

import corpus_pipeline
from tests_llm_brute import brute_base, brute_contamination, brute_similar_groups, shingle_set
from steadyline.llm import chat, queries, warc
from steadyline.llm.lattice import decoded, pieces

# ---- WARC

PAGES = "page_id bigint, url string, html string, name string, content string"


def pages(spark, n=60):
    rng = random.Random(1)
    body = lambda: "<html>é " + " ".join(rng.choice(["alpha", "beta", "漢字", "<p>"]) for _ in range(rng.randint(1, 200))) + "</html>"
    rows = [(i, f"https://example.org/{i}", body()) for i in range(n)]
    rows += [(100 + i, "https://example.org/copy", rows[5][2]) for i in range(20)] + [(3, "x", rows[5][2])]
    rows += [(200, None, None), (201, "bad\r\nWARC-Type: x", ""), (202, "u", "z" * 300_000), (None, "u", rows[7][2]), (None, "u", "only here"), (9, rows[9][1], rows[9][2])]
    return rows, spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("least", [0, 1, 10_000])
def test_archives_round_trip(spark, least):
    rows, df = pages(spark)
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", []).append(i)
    first = {h: min((i for i in own if i is not None), default=None) for h, own in first.items()}
    got = warc.read_records(warc.write_archives(df, least)).collect()
    assert all(r.error is None for r in got)
    pages_back = [r for r in got if r.record_type != "warcinfo"]
    assert len(pages_back) == len(rows)
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and first[html or ""] != i
        name = lambda x: f"<urn:page:{'' if x is None else x}>"
        want.append((name(i), "revisit" if again else "response", base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), str(name(first[html or ""]) if again else None), str(None if again else data)))
    assert sorted((r.record_id, r.record_type, r.payload_digest, r.payload_bytes, str(r.refers_to), str(r.payload and bytes(r.payload) if r.payload is not None else None)) for r in pages_back) == sorted(want)
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_files_in_a_folder(spark, tmp_path):
    _, df = pages(spark)
    archives = warc.write_archives(df)
    warc.export(archives, f"file://{tmp_path}/out")
    again = warc.read_records(warc.open_archives(spark, f"file://{tmp_path}/out"))
    one = lambda d: sorted(str(r) for r in d.drop("name").collect())
    assert one(again) == one(warc.read_records(archives))


def test_archives_do_not_depend_on_the_order_of_rows(spark):
    rows, _ = pages(spark)
    copies = [(i, url, rows[5][2], "a", "b") for i, url, _ in rows]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the join may deal rows otherwise from run to run
    try:
        one, other = (sorted(warc.write_archives(spark.createDataFrame(r, PAGES).coalesce(1)).collect()) for r in (copies, copies[::-1]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert one == other and len(one) > 0


def sample_archive(n=40, dictionary=True):
    records = [warc.page_record(f"<urn:page:{i}>", f"https://e.org/{i}", b"<p>hello %d</p>" % i * 30, warc.base32_sha1(b"<p>hello %d</p>" % i * 30), None) for i in range(n)]
    return records, warc.pack(records if dictionary else records[:3])


def test_dictionary_leads_and_each_record_is_a_frame():
    records, data = sample_archive()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8:12] == warc.FRAME
    rows = list(warc.records("a", data))
    assert [r[1] for r in rows][0] == 8 + size and len(rows) == 40 and not any(r[9] for r in rows)
    assert all(warc._frame_end(memoryview(data), a[1]) == b[1] for a, b in zip(rows, rows[1:]))
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size])
    plain = struct.pack("<II", 0x184D2A5D, len(raw)) + raw + data[8 + size :]  # the dictionary may also be stored as it is
    assert [r[2] for r in warc.records("a", plain)] == [r[2] for r in rows]
    few = warc.pack(records[:3])
    assert few[:4] == warc.FRAME and len(list(warc.records("a", few))) == 3
    assert list(warc.records("a", b"")) == []


def test_skippable_frames_are_stepped_over():
    records, data = sample_archive()
    whole = list(warc.records("a", data))
    extra = [struct.pack("<II", 0x184D2A50 + i, len(b)) + b for i, b in enumerate([b"", b"padding" * 9, b"x"])]
    at = [r[1] for r in whole] + [len(data)]
    padded = b"".join([*extra, data[: at[0]], extra[0], *[data[a:z] + extra[i % 3] for i, (a, z) in enumerate(zip(at, at[1:]))]])
    padded += struct.pack("<II", 0x184D2A5D, 3) + b"abc"  # no dictionary so late
    plain = lambda rows: [(r[0], *r[2:]) for r in rows]
    assert plain(warc.records("a", padded)) == plain(whole)
    few = warc.pack(records[:3])
    assert plain(warc.records("a", extra[1] + few + extra[2])) == plain(warc.records("a", few))
    cut = list(warc.records("a", data + extra[1][:-1]))
    assert plain(cut[:-1]) == plain(whole) and "cut off" in cut[-1][9]
    assert list(warc.records("a", extra[1])) == []


def test_sampled_ids_are_returned(spark):
    found = queries.op2_sampled_segmentations(spark, "/root/testdata/sf0.001").limit(50)
    assert all(len(r.ids) == r.n_pieces and r.exact for r in found.collect())


def test_faults_are_rows(spark):
    records, data = sample_archive()
    whole = list(warc.records("a", data))
    flipped = bytearray(data)
    flipped[whole[10][1] + 20] ^= 0xFF  # inside the 11th frame
    rows = list(warc.records("a", bytes(flipped)))
    assert sum(r[9] is not None for r in rows) == 1 and rows[10][9]
    cut = list(warc.records("a", data[:-5]))
    assert len(cut) == 40 and "cut off" in cut[-1][9]
    assert "dictionary" in list(warc.records("a", data[:100]))[0][9]
    pack = zstandard.ZstdCompressor().compress
    good = records[0]
    for bad, why in [
        (good.replace(b"WARC/1.1", b"WARC/9.9"), "no WARC header"), (good.replace(b"WARC-Date", b"WARC-Dat"), "no WARC-Date"), (good[:-1], "Content-Length"),
        (good.replace(b"hello 0", b"hellO 0"), "digest"), (good.replace(b"text/html; charset=utf-8\r\nContent-Length: ", b"text/html; charset=utf-8\r\nContent-Length: 1"), "Content-Length"),
        (good[:-4] + b"abcd", "line breaks"), (b"", "no WARC header"),
    ]:
        (row,) = warc.records("a", pack(bad))
        assert row[9] and why in row[9], (row[9], why)
    df = spark.createDataFrame([("a", bytearray(flipped)), ("b", None), ("c", bytearray(data))], "name string, content binary")
    assert warc.read_records(df).groupBy("name").count().orderBy("name").collect() == [("a", 40), ("c", 40)]


# ---- chat

EVENTS = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string, formatted string"


def brute_fold(events):
    out = {}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0, x[3] or "delta", x[4] or "", x[5] or "")
    for c, seq, m, kind, role, text in sorted(events, key=key):
        conv = out.setdefault(c, {})
        if kind == "regenerate":
            for later in [k for k in conv if k >= m]:
                del conv[later]
        old = conv.get(m, ("", ""))[1]
        conv[m] = (role or "", (old if kind in (None, "delta") else "") + (text or ""))
    return {c: [conv[m] for m in sorted(conv)] for c, conv in out.items()}


def run_chat(spark, events):
    df = spark.createDataFrame([(*e, "x") for e in events], EVENTS).repartition(3)
    done = chat.rendered(chat.folded(df))
    return {r.conv_id: r for r in chat.read_back(done).collect()}, {r.conv_id: r for r in done.collect()}


def test_events_fold_and_read_back(spark):
    hard = ["", "<|im_end|>", "<|im_start|>assistant\nok", "%3C|im_end|>", "%25", "% <|", "<", "|", "\n\n", "漢字 𝄞", "\\<\\|", "a\x00b"]
    rng = random.Random(6)
    events = []
    for c in [None, *range(30)]:
        seq = 0
        for m in range(rng.randint(1, 6)):
            for _ in range(rng.randint(1, 4)):
                seq += 1
                events.append((c, seq, m, rng.choice(["delta", "delta", "delta", None, "edit", "regenerate"]), rng.choice(["user", "assistant", "assistant", "sys\ntem<|%0A"]), rng.choice(hard)))
            if rng.random() < 0.2:
                seq += 1
                events.append((c, seq, rng.randint(0, m), "regenerate", "assistant", rng.choice(hard)))
    events += [(99, 1, 0, "delta", None, None), (98, 1, 0, "delta", "assistant", "x" * 200_000), (97, 1, 0, "delta", "user", "a"), (97, 1, 0, "delta", "user", "a")]
    back, done = run_chat(spark, events)
    want = brute_fold(events)
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(t for r, t in turns if r == "assistant") and back[c].chars == len(done[c].formatted)
        assert done[c].formatted.count("<|im_start|>") == done[c].formatted.count("<|im_end|>") == len(turns)


def test_no_events(spark):
    df = spark.createDataFrame([], EVENTS)
    assert chat.read_back(chat.rendered(chat.folded(df))).count() == 0


def test_query_on_the_planted_conversation(spark):
    row = queries.op7_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = queries.HARD_TEXT
    assert (row.n_turns, row.loss_chars) == (2, len(text)) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ---- pipeline


def test_pipeline_names_its_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


def test_pipeline_decisions(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs = read("documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
        after = docs.collect()
        kept = {r.doc_id for r in after}
        if name == "quality":
            right = [(r.doc_id in kept) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]
            assert sum(right) >= 0.97 * len(right)
        elif name == "near_duplicates":
            group = brute_similar_groups([shingle_set(r.text) for r in before])
            least = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                least.setdefault(group[shingle_set(r.text)], r.doc_id)
            assert kept == set(least.values())
        elif name == "decontamination":
            bad = {int(x[0]) for x in brute_contamination([(r.doc_id, r.text) for r in before], items) if x[4]}
            assert kept == {r.doc_id for r in before} - bad
        elif name == "secrets":
            assert not any(brute_base(r.text) for r in after) and all(r.n_chars == len(r.text) for r in after)
            plain = {r.doc_id: r.text for r in before if not brute_base(r.text)}
            assert {r.doc_id: r.text for r in after if r.doc_id in plain} == plain and len(after) == len(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        else:
            text = {r.doc_id: r.text for r in before}
            assert all(r.decoded == text[r.doc_id] for r in decoded(docs, pieces(queries.PIECES)).collect())
        before = after
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "sample", "ids").collect())) == sorted(map(str, docs.select("doc_id", "sample", "ids").collect()))
