"""Chat formatting and WARC: exact round trips, escapes, pushdown, foreign archives."""

import gzip
import hashlib

import numpy as np
import pytest

from tallygrid.llm import chat_format as cf
from tallygrid.llm import warc
from tallygrid.llm.common import shared_folder, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ROWS = "conv_id long, turn long, role string, text string, formatted string, loss int"
ODD = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\</s>", "[\\INST]", "<|endoftext|>", "日本 é😀‍ \n\n ", "  lead", "trail  ", "<<s>>", "[[INST]]"]


def test_round_trip(spark):
    rows = []
    for c in range(12):
        rows.append((c, 0, "system" if c % 3 else None, ODD[c], "x", 1))
        for t in range(1, 5):
            rows.append((c, t, "assistant" if t % 2 else "user", ODD[(c + 3 * t) % len(ODD)], "x", 1))
    rows += [(None, 1, "assistant", "no id", "", 0), (50, None, "assistant[INST]", "odd role", "", 0), (51, 1, "assistant", "w " * 90_000, "", 0)]
    out = {r["conv_id"]: r for r in cf.read_back(cf.formatted(spark.createDataFrame(rows, ROWS).repartition(5), PATH)).collect()}
    assert len(out) == 15
    for conv, r in out.items():
        turns = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        learned = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    empty = spark.createDataFrame([], ROWS)
    assert cf.read_back(cf.formatted(empty, PATH)).count() == 0


def test_repeated_turns_stay(spark):
    rows = [(1, 1, "assistant", "same", "", 0)] * 3
    row = cf.read_back(cf.formatted(spark.createDataFrame(rows, ROWS), PATH)).first()
    assert row["n_turns"] == 3 and row["loss_chars"] == 12


def test_texts_make_no_control_tokens(spark):
    rules = cf.template(PATH)
    controls = {rules.tokenizer.token_to_id(c) for c in (cf.BEGIN, cf.HEAD, cf.BODY, cf.END, "<|endoftext|>")}
    for text in ODD:
        assert not controls & set(rules.tokenizer.encode(rules.escape(text or ""), add_special_tokens=False).ids)
        assert cf.unescape(rules.escape(text or "")) == (text or "")


def test_mask_by_binary_search():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.sort(rng.choice(np.arange(1, 60), 20, replace=False))
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [60]))
        edge = np.sort(rng.choice(60, 4, replace=False)).tolist()
        spans = [(edge[0], edge[1]), (edge[2], edge[3])]
        plain = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
        assert cf.under(spans, starts, ends).tolist() == plain


PAGES = "page_id long, url string, html string, payload_digest string, first int"


def pages(spark):
    big, other = "<p>é</p>" * 40, "<div>" + "x" * 120 + "</div>"
    rows = [(k, f"http://h/{k}", big, "", 0) for k in range(3, 40)] + [(k, None, other, "", 0) for k in (70, 60, 65)]
    rows += [(100, "http://a\r\nb", "short", "", 0), (101, "", "short", "", 0), (102, "u", None, "", 0), (103, "u", "", "", 0),
             (104, "u", "a\r\n\r\nb" * 50_000, "", 0), (60, None, other, "", 0), (None, "n", big, "", 0), (None, "n", "q" * 200, "", 0)]
    return spark.createDataFrame(rows, PAGES), rows


def plain_records(rows):
    first = {}
    for page, _, html, _, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, _, _ in rows:
        data = (html or "").encode()
        to = first.get(data)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), *(("response", None) if to is None or to == page else ("revisit", to))))
    return out


def test_archives_give_back_every_page(spark):
    df, rows = pages(spark)
    got = [tuple(r) for r in warc.archived_pages(df.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(plain_records(rows), key=str)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_pushdown_and_headers_only(spark):
    df, rows = pages(spark)
    path = shared_folder(spark, "warc-test")
    warc.write_pages(df, path)
    found = warc.read_archives(spark, path).where("record_type = 'revisit' and refers_to = 'urn:page:3'")
    assert found.count() == sum(r[3:] == ("revisit", 3) for r in plain_records(rows))
    heads = warc.read_archives(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0 and heads.count() == len(rows)
    reader = warc.WarcReader({"path": path})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")]))
    assert len(rest) == 1 and reader.tests == [("record_type", ("response",))]
    kept = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert kept and {r["record_type"] for r in kept} == {"response"}


@pytest.mark.parametrize("payload", [True, False])
def test_foreign_archive(spark, tmp_path, payload):
    """Members without the length field, as other writers make them, and no listing."""
    records = [{"record_id": f"urn:page:{k}", "record_type": "response", "target_uri": "u", "payload_digest": "d",
                "payload_bytes": 0, "refers_to": None, "payload": b"z%d" % k * 9000 * k} for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes(r)) for r in records))
    reader = warc.WarcReader({"path": str(tmp_path), "payload": str(payload)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == [r["record_id"] for r in records]
    assert [r["payload"] for r in rows] == [r["payload"] if payload else None for r in records]
    assert [r["payload_bytes"] for r in rows] == [len(r["payload"]) for r in records]


def test_appends_add_and_overwrite_replaces(spark):
    path = shared_folder(spark, "warc-test")
    page = lambda k: spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * 30)], "page_id long, url string, html string")
    ids = lambda: sorted(r["record_id"] for r in warc.read_archives(spark, path).collect())
    warc.write_pages(page(1), path)
    warc.write_pages(page(2), path)
    warc.write_pages(page(3), path)
    assert ids() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    warc.page_records(page(4)).write.format("warc").mode("overwrite").save(path)
    assert ids() == ["urn:page:4"]
    warc.write_pages(page(5).limit(0), path)
    assert ids() == ["urn:page:4"]


def test_files_of_a_write_under_way_are_not_read(spark, tmp_path):
    """Neither in a folder without lists nor in one with them."""
    record = lambda k: {"record_id": f"urn:page:{k}", "record_type": "response", "target_uri": None, "payload_digest": None,
                        "payload_bytes": 0, "refers_to": None, "payload": None}
    (tmp_path / "_part-000000-x-0.warc.gz").write_bytes(warc.member(warc.record_bytes(record(1))))

    def read():
        reader = warc.WarcReader({"path": str(tmp_path)})
        return [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert read() == []
    warc.register(spark)
    warc.page_records(spark.createDataFrame([(7, "u", "h")], "page_id long, url string, html string")).write.format("warc").mode("append").save(str(tmp_path))
    assert read() == ["urn:page:7"]


def test_registered_query_pushes_record_types_down(spark):
    """Both reads test the type while they scan: no comparison with it is left above the scans."""
    df, rows = pages(spark)
    plan = warc.archived_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "= response" not in plan and "= revisit" not in plan
