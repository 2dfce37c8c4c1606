"""DataFrame operators, the native expressions against the readers' own functions, and all queries against SQL."""

from __future__ import annotations

import glob
import os
import random
import sys

import duckdb
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__
from foliospark.functions import detect as dt
from foliospark.functions import images as im
from foliospark.functions import text as tx
from foliospark.functions import views
from foliospark.functions.json import object_in
from foliospark.operators import model_call, payload, tree
from foliospark.operators.filters import KEEP_ALL, ImageFilter, apply_filter, partition_images
from foliospark.operators.prepare import CONTAINER_NOTE, WARNING, decided, finish, judged, prepare, prepare_all, summary
from foliospark.plans import fixtures as fx
from foliospark.plans import queries, selfcheck
from foliospark.plans.oracle import ORACLE
from foliospark.plans.report import report
from foliospark.sources.extract import extract, text_documents
from foliospark.sources.probe import image_size
from foliospark.sources.readers.bundles import safe_name
from foliospark.sources.readers.ooxml import natural_key
from foliospark.sources.sinks import document_images, image_files, write_files
from foliospark.sources.sniff import detect, sniff_mime, suffix_of
from foliospark.streaming.files import extract_to, stream_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
DATA = "/root/testdata/sf0.001"
LINE = "Certificate of record, issued by the county clerk, with names, dates and places as entered. " * 3
SCAN, SMALL = fx.png(900, 1200), fx.png(64, 64)


def files(spark, members, parts=3):
    return spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else v.encode())) for k, v in members.items()], "path string, content binary").repartition(parts)


MEMBERS = {
    "d/typed.docx": fx.docx(fx.para(LINE)), "d/scan.docx": fx.docx(fx.blip("rId1") + fx.blip("rId2"), {"s.png": SCAN, "seal.png": SMALL}), "d/both.docx": fx.docx(fx.para(LINE) + fx.blip("rId1") + fx.blip("rId2"), {"s.png": SCAN, "t.png": SCAN}),
    "d/blank.docx": fx.docx(""), "d/short.docx": fx.docx(fx.para("short")), "d/short.csv": "a,b\n1,2\n", "d/deck.pptx": fx.pptx([([LINE], None)]), "d/book.xlsx": fx.xlsx({"S": [["Field", "Value"], ["Name", "Ann"], ["Place of birth", "Here in the county"], ["Issued", "by the clerk of it"], ["No", "123456"]]}),
    "d/mail.eml": fx.eml("Hi", LINE, {"w.docx": fx.docx(fx.para(LINE)), "p.png": SCAN}), "d/plain.eml": fx.eml("Hi", LINE), "d/set.zip": fx.zipped({"one.txt": LINE, "two.docx": fx.docx(fx.blip("rId1"), {"s.png": SCAN})}), "d/none.zip": fx.zipped({}), "d/odd.bin": b"\0\1", "d/pic.png": SCAN,
    "d/emf.docx": fx.docx(fx.blip("rId1"), {"m.emf": b"\1\0\0\0" + bytes(20000)}),
}


@pytest.fixture(scope="module")
def docs(spark):
    return extract(files(spark, MEMBERS)).cache()


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_strategies(docs):
    got = by(prepare(docs, render_fallback=False), "doc_id", "strategy")
    want = {"typed.docx": "text_only", "scan.docx": "image_only", "both.docx": "hybrid", "blank.docx": "empty", "short.docx": "image_only", "short.csv": "text_only", "deck.pptx": "image_only", "book.xlsx": "text_only", "mail.eml": "hybrid", "plain.eml": "text_only", "set.zip": "hybrid", "none.zip": "empty", "pic.png": "image_only", "odd.bin": "empty", "emf.docx": "image_only"}
    assert got == {f"d/{k}": v for k, v in want.items()}


def test_members(docs):
    got = by(prepare_all(docs, render_fallback=False), "doc_id", "strategy")
    assert {k: v for k, v in got.items() if ".eml" in k or ".zip" in k} == {"d/mail.eml#0": "text_only", "d/mail.eml#1": "image_only", "d/plain.eml": "text_only", "d/set.zip#0": "text_only", "d/set.zip#1": "image_only"}


def test_notes_and_summary(docs, spark):
    notes = by(prepare(docs, render_fallback=False), "doc_id", "notes")
    assert notes["d/short.docx"] == ["image_only: 5 body chars (threshold 180), 0 image(s) kept, 0 filtered out", "no sendable image and render_fallback is off", WARNING]
    tried = by(prepare(docs, files(spark, MEMBERS)), "doc_id", "notes")
    assert tried["d/short.docx"][1].startswith("page rendering unavailable: ") and tried["d/short.docx"][-1] == WARNING and WARNING not in tried["d/blank.docx"]
    poor = extract(files(spark, {"a.zip": fx.zipped({"x.docx": fx.docx(fx.para("s"))})}))
    assert CONTAINER_NOTE in prepare(poor).first()["notes"]
    lines = by(summary(prepare(docs, render_fallback=False)), "doc_id", "summary")
    assert lines["d/both.docx"] == f"both.docx [docx]: hybrid, 1 image(s), {len(LINE.strip())} text chars"


def test_rendered_image_files_replace_filtered_ones(spark):
    """A picture file that the filter drops is its own page."""
    own = files(spark, {"s.png": SMALL})
    row = prepare(extract(own), own).first()
    assert row["rendered"] and row["strategy"] == "image_only" and row["kept"][0]["width"] == 64
    assert "fell back to 1 page render(s) at 250 dpi" in row["notes"]


def test_thresholds_given(docs):
    got = by(prepare(docs, min_text_chars=5, render_fallback=False), "doc_id", "threshold")
    assert set(got.values()) == {5}
    assert by(prepare(docs, min_text_chars=180, render_fallback=False), "doc_id", "threshold")["d/deck.pptx"] == 400


def test_views(docs):
    row = docs.filter("doc_id = 'd/book.xlsx'").select(views.lookup(F.col("tables")[0]["rows"], "place OF-birth").alias("p"), views.lookup(F.col("tables")[0]["rows"], "nothing").alias("n"), F.size(views.pairs(F.col("tables")[0]["rows"])).alias("k"), F.size(views.cells(F.col("tables")[0]["rows"])).alias("c")).first()
    assert tuple(row) == ("Here in the county", "", 5, 10)
    row = docs.filter("doc_id = 'd/both.docx'").select(views.interleaved(F.col("blocks")).alias("b"), views.summary(F.col("name"), F.col("kind"), F.lit("hybrid"), F.col("blocks"), F.col("n_children")).alias("s")).first()
    assert [b["ord"] for b in row["b"]] == [0, 1, 2]
    assert row["s"] == f"both.docx [docx] strategy=hybrid text={len(LINE.strip())}ch images=2 (900x1200, 900x1200)"


def test_tree_text(docs):
    out = by(tree.all_body_text(views.with_views(docs)), "root_id", "all_body_text")
    assert out["d/set.zip"] == f"--- one.txt ---\n{LINE.strip()}"
    assert out["d/mail.eml"].startswith("From: ") and out["d/mail.eml"].count("\n\n--- w.docx ---\n") == 1
    assert {r["doc_id"] for r in tree.leaves(docs).collect()} == {r["doc_id"] for r in tree.leaves_by_join(docs).collect()}


def test_errors_are_rows(docs, spark):
    errors = {r["doc_id"]: r["error"] for r in docs.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"d/odd.bin"} and errors["d/odd.bin"]["type"] == "UnsupportedFormat"
    with pytest.raises(Exception, match="no registered backend"):
        extract(files(spark, {"x.bin": b"\0\1"}), mode="raise").collect()


def test_text_columns_are_text_files(spark):
    rows = [(1, " a \n"), (2, ""), (3, None), (4, LINE), (5, "　wide " * 9 + "　\x1c")]
    native = text_documents(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("doc_id").collect()
    read = extract(spark.createDataFrame([(str(i), bytearray(("x" if not t else t).encode())) for i, t in rows], "path string, content binary")).orderBy("doc_id").collect()
    for a, b, (_, t) in zip(native, read, rows):
        if t:
            assert [x["text"] for x in a["blocks"]] == [x["text"] for x in b["blocks"]]
        else:
            assert a["blocks"] == []


# images


def model_partition(rows, f):
    """The filter, plainly."""
    seen, kept, rejected = set(), [], []
    for r in rows:
        w, h = r["width"], r["height"]
        if f.drop_vector and r["mime"] in ("image/x-emf", "image/x-wmf", "image/svg+xml"):
            why, ok = f"vector format {r['mime']}", False
        elif r["nbytes"] < f.min_bytes:
            why, ok = f"{r['nbytes']}B under min_bytes={f.min_bytes}", False
        elif w is None or h is None:
            why, ok = "dimensions unknown", f.keep_unsized
        elif w < f.min_width or h < f.min_height:
            why, ok = f"{w}x{h} under minimum", False
        elif w * h < f.min_pixels:
            why, ok = f"{w * h}px under min_pixels", False
        else:
            why, ok = "ok", True
        if ok and f.drop_duplicates:
            if r["sha256"] in seen:
                why, ok = "duplicate of an earlier image", False
            seen.add(r["sha256"])
        (kept if ok else rejected).append((r["pos"], why))
    area = {r["pos"]: ((r["width"] or 0) * (r["height"] or 0), r["nbytes"], r["ord"]) for r in rows}
    kept.sort(key=lambda x: (-area[x[0]][0], -area[x[0]][1], area[x[0]][2]))
    most = len(kept) if f.max_images is None else f.max_images
    return [p for p, _ in kept[:most]], rejected + [(p, f"beyond max_images={f.max_images}") for p, _ in kept[most:]]


@pytest.mark.parametrize("flt", [ImageFilter(), KEEP_ALL, ImageFilter(max_images=2), ImageFilter(drop_vector=True, keep_unsized=False, max_images=0), ImageFilter(min_bytes=10, min_pixels=500, min_width=5, min_height=5, drop_duplicates=False, max_images=3)])
def test_filters_agree(spark, flt):
    r = random.Random(1)
    rows = []
    for doc in range(12):
        for pos in range(r.choice([0, 1, 4, 12])):
            w = r.choice([None, 0, 4, 150, 300, 900])
            rows.append({"doc_id": str(doc), "pos": pos, "ord": r.randint(0, 3), "mime": r.choice(["image/png", "image/x-emf"]), "width": w, "height": r.choice([None, 2, 300, 1200]), "nbytes": r.choice([5, 15000, 70000]), "sha256": r.choice("abc")})
    df = spark.createDataFrame(rows, "doc_id string, pos int, ord int, mime string, width int, height int, nbytes int, sha256 string")
    flat, nested = {}, {}
    for x in apply_filter(df, flt).collect():
        flat.setdefault(x["doc_id"], []).append(x)
    blocks = F.array_sort(F.collect_list(F.struct("pos", "ord", "mime", "width", "height", "nbytes", "sha256")))
    for x in df.groupBy("doc_id").agg(blocks.alias("i")).select("doc_id", partition_images(F.col("i"), flt).alias("p")).collect():
        nested[x["doc_id"]] = x["p"]
    for doc in {r["doc_id"] for r in rows}:
        kept, rejected = model_partition([x for x in rows if x["doc_id"] == doc], flt)
        assert [x["pos"] for x in sorted((x for x in flat[doc] if x["status"] == "kept"), key=lambda x: x["rank"])] == kept
        assert {(x["pos"], x["reason"]) for x in flat[doc] if x["status"] == "rejected"} == set(rejected)
        assert [x["pos"] for x in nested[doc]["kept"]] == kept
        assert [(x["image"]["pos"], x["reason"]) for x in nested[doc]["rejected"]] == rejected


def test_native_sizes_and_kinds_agree_with_readers(spark):
    r = random.Random(2)
    heads = [b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"GIF87a", b"BM", b"RIFF____WEBPVP8X", b"RIFF____WEBPVP8 ", b"RIFF____WEBPVP8L", b"\xff\xd8", b"\0\0\0\x18ftypmif1", b" <svg ", b"%PDF", b"{\\rt", b"From ", b"<p>", b"Subject: x\nFrom: y\nTo: z\n", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"plain text", b"", b"PK\x03\x04"]
    own = {}
    for i in range(300):
        body = r.randbytes(r.choice([0, 3, 40])) if i % 2 else bytes(r.choice(b"abc xyz\n\t") for _ in range(50))
        own[f"{i}/n{r.choice(['', '.png', '.ZIP', '.txt', '.xls', '.tar.gz', '.'])}"] = r.choice(heads) + body
    own |= {f"z/{k}": v for k, v in MEMBERS.items()}
    df = dt.with_kind(files(spark, own)).select("path", "kind", dt.sniff_mime(F.col("content"), F.col("path")).alias("mime"), im.image_size(F.col("content"), jpeg=True).alias("size"), tx.suffix_of(F.col("path")).alias("suffix"))
    for x in df.collect():
        data = own[x["path"]]
        data = data.encode() if isinstance(data, str) else data
        assert x["suffix"] == suffix_of(x["path"]), x["path"]
        assert x["kind"] == detect(data, x["path"]), x["path"]
        assert x["mime"] == sniff_mime(data, x["path"]), x["path"]
        assert (x["size"] and tuple(x["size"])) == image_size(data), x["path"]


def test_texts_whose_head_ends_within_a_character(spark):
    """Long texts stay texts wherever the sniffed head parts a character; broken ends stay broken."""
    tails = ["Á" * 40, "Á”" * 40, "😀Á" * 40]
    own = {f"{k}/{i}": (b"a" * (65536 - i) + t.encode()) for k, t in enumerate(tails) for i in range(12)}
    own |= {f"bad/{i}": b"\x81" + b"a" * (65535 - i) + "Á😀".encode()[:i] for i in range(1, 6)}
    own |= {f"mid/{i}": b"\x81" * 4 + b"a" * 70000 + b"\xf0" * i for i in range(3)}
    own |= {f"odd/{i}": b"\x81" + b"a" * (65535 - len(e)) + e + b"\x80" * 9 for i, e in enumerate((b"\xe0\x80", b"\xed\xa0", b"\xf0\x80", b"\xf4\x90", b"\xe0\xa0", b"\xf4\x8f\xbf", b"\xc1"))}
    # A file that ends within a character is not valid, with or without a longer head.
    own |= {f"end/{n}": b"\xc3\x81" + b"a" * (n - 3) + b"\xc3" for n in (100, 65536, 65537)}
    found = {x["path"]: x["kind"] for x in dt.with_kind(files(spark, own)).collect()}
    assert found == {k: detect(v, k) for k, v in own.items()}
    assert all(found[k] == "text" for k in own if k[0] in "012")
    assert found["end/100"] == found["end/65536"] == "unknown" and found["end/65537"] == "text"


def test_names(spark):
    names = ["a/b.txt", "..\\..\\x?.doc", "  ", "über (1)[2].x", "x" * 300, "a/", "..", "slide10.xml", "$%&"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.safe_name(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: safe_name(n) for n in names}
    parts = [f"s{i}x{j}" for i in (1, 2, 10, 9) for j in (3, 20)] + ["s", "s1"]
    order = [r["n"] for r in spark.createDataFrame([(n,) for n in parts], "n string").orderBy(tx.natural_key(F.col("n"))).collect()]
    assert order == sorted(parts, key=natural_key)


# models


def test_json_objects():
    assert object_in('{"a": 1}') == object_in('x {"a": 1} y') == object_in('```json\n{"a": 1}\n```') == object_in('[{"a": 1}, 2]') == {"a": 1}
    assert object_in('{"a": 1, "a": 2}') == {"a": 2}
    for junk in (None, "", "  ", "no", "[]", "[1]", "3", "{a}", "}{"):
        assert object_in(junk) is None


class Fake:
    """A model that answers with a fixed reply, in parts."""

    def __init__(self):
        self.chat = self.completions = self

    def create(self, messages, **_):
        kinds = [p["type"] for p in messages[0]["content"]]
        if "Document text:" in str(messages):
            return {"choices": [{"message": {"content": [{"text": '{"n": '}, {"text": f"{len(kinds)}}}"}]}}]}
        if kinds.count("image_url") > 1:
            raise ValueError("too many")
        return {"choices": [{"message": {"content": '```json\n{"n": NaN, "pictures": %d}\n```' % kinds.count("image_url")}}]}


def test_readings(docs):
    ready = prepare(docs.filter("depth = 0"), render_fallback=False).join(docs.select("doc_id", "blobs"), "doc_id")
    got = {r["doc_id"]: r for r in model_call.read(ready, {"n": "a number"}, client_factory=Fake).collect()}
    assert got["d/typed.docx"]["data"] == '{"n":2}' and not got["d/typed.docx"]["used_vision"]
    assert got["d/both.docx"]["data"] == '{"n":null,"pictures":1}' and got["d/both.docx"]["images_sent"] == 1
    assert got["d/blank.docx"]["error"] == model_call.NOTHING and got["d/emf.docx"]["error"] == model_call.UNSENDABLE
    assert "m.emf (image/x-emf) is not API-consumable; render the page instead" in got["d/emf.docx"]["notes"]
    assert got["d/short.docx"]["ok"]
    with pytest.raises(ValueError, match="fields= or prompt="):
        model_call.read(ready)


def test_failing_calls_are_errors(docs):
    def broken():
        raise RuntimeError("no server")

    ready = prepare_all(docs, render_fallback=False)
    got = model_call.read(ready.filter("strategy = 'text_only'"), prompt="x", client_factory=broken).collect()
    assert got and all(r["error"] == "RuntimeError: no server" and not r["ok"] for r in got)


def test_prompt_and_parts(spark):
    said = model_call.build_prompt({"name": "who", "date": "when"})
    assert said.startswith(model_call.ASK + "\n\n" + model_call.KEYS + "\n  name: who\n  date: when\n\nRules:\n- Use null")
    fields = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("description")) for k, v in (("name", "who"), ("date", "when"))])
    assert spark.range(1).select(model_call.prompt_of(fields, F.lit(" "))).first()[0] == said
    data = F.lit(b"x" * 300)
    one = spark.range(1).select(payload.data_url(F.lit("image/png"), data).alias("u"), F.to_json(payload.image_part(F.lit("image/png"), data, "anthropic")).alias("a")).first()
    assert len(one["u"]) == len("data:image/png;base64,") + 400 and one["a"].startswith('{"type":"image","source":{"type":"base64"')
    with pytest.raises(ValueError, match="dialect"):
        payload.image_part(F.lit("a"), data, "other")
    assert model_call.message_text({"choices": []}) == "" and model_call.message_text({"choices": [{"message": {"content": "x"}}]}) == "x"


def test_normalized_images(spark):
    rows = [("a", "image/png", 10, 10, bytearray(b"p")), ("b", "image/x-emf", None, None, bytearray(b"e")), ("c", "image/tiff", 5, 5, bytearray(b"t")), ("d", "image/jpeg", 5000, 10, bytearray(b"j"))]
    got = {r["n"]: (r["usable"], r["mime"]) for r in payload.normalized(spark.createDataFrame(rows, "n string, mime string, width int, height int, data binary")).collect()}
    assert got["a"] == (True, "image/png") and not got["b"][0] and not got["c"][0] and got["d"][0]


# jobs


def test_report_and_sinks(docs, tmp_path):
    ready = prepare_all(docs, render_fallback=False)
    lines = [r["line"] for r in report(ready, docs, text=True).filter("doc_id = 'd/both.docx'").orderBy("n").collect()]
    assert lines[0] == "kind         docx" and any("1 kept, 1 filtered" in x for x in lines) and any(x.startswith("  - t.png") and "duplicate" in x for x in lines) and "--- text ---" in lines
    write_files(image_files(ready), str(tmp_path))
    made = {os.path.relpath(p, tmp_path) for p in glob.glob(f"{tmp_path}/**/*.png", recursive=True)}
    assert "both/both/000-s.png" in made and open(tmp_path / "both/both/000-s.png", "rb").read() == SCAN
    assert "scan-001.png" in {r["path"] for r in document_images(docs).collect()}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.csv"):
        (tmp_path / "in" / n).write_text("x,y\n1,2\n")
    for _ in range(2):  # what was read is not read again
        extract_to(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pages_find_images_beside_them(spark):
    own = {"s/site/a.html": '<p>x</p><img src="pics/i.png"><img src="../out.png">', "s/site/pics/i.png": SCAN, "s/out.png": SCAN, "s/other/b.html": "<p>y</p>"}
    rows = {r["name"]: r for r in extract(files(spark, own), sidecars=True).collect()}
    assert len(rows) == 4 and [b["name"] for b in rows["a.html"]["blocks"] if b["is_image"]] == ["i.png"]
    assert rows["a.html"]["warnings"] == ["image path escapes the document folder: ../out.png"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, content binary")
    docs = extract(none)
    assert docs.collect() == [] and prepare(docs).collect() == [] and prepare_all(docs, none).collect() == []


def test_selfcheck(spark, capsys):
    assert selfcheck.run(spark)


def test_image_bytes_are_pruned(spark, tmp_path, docs):
    """Text work never reads image bytes."""
    docs.write.parquet(f"{tmp_path}/docs")
    plan = spark.read.parquet(f"{tmp_path}/docs").select(views.body_text(F.col("blocks")))._jdf.queryExecution().toString()
    assert "ReadSchema" in plan and "data:binary" not in plan.split("ReadSchema")[1]


# queries


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def values(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(["-" if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in row]) for row in df.values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), oracle.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", ["strategies_with_images", "message_contents", "kind_report", "prepare_notes"])
def test_sets_of_images_are_judged_once(spark, tmp_path, name):
    """Documents that share a set of many images get its numbers; no row holds the images themselves."""
    parts = [(i, f"p{i}", f"Brand#{i % 7}", "STANDARD" if i % 3 else "LARGE", i % 50 + 1, 895 + i % 977 + 0.5) for i in range(200 * 40)]
    spark.createDataFrame([r for r in parts if r[0] % 200 < 150], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    texts = (None, "", " \n", "short", 'x"\\\n' * 60)
    spark.createDataFrame([(i, texts[i % 5], "en", "a", 1) for i in range(0, 6000, 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("part", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert values(got.toPandas()) == values(c.sql(ORACLE[name]).df())
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_numbers_decide_as_images_do(spark, docs):
    rows = docs.select("doc_id", "kind", "n_children", views.body_text(F.col("blocks")).alias("text"), views.images(F.col("blocks")).alias("images"))
    whole = judged(rows)
    numbers = whole.select("doc_id", "kind", "n_children", "text", F.size("images").alias("i"), F.size("kept").alias("k"), F.size("rejected").alias("r"))
    own = finish(decided(numbers, F.col("i"), F.col("k"), F.col("r")), render_fallback=False, n_kept=F.col("k"))
    same = ("doc_id", "threshold", "strategy", "notes", "needs_vision")
    assert sorted(own.select(*same).collect()) == sorted(finish(whole, render_fallback=False).select(*same).collect())
    with pytest.raises(ValueError):
        finish(own, n_kept=F.col("k"))


@pytest.mark.parametrize("name", ["html_titles", "html_texts"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    """Titles and headings that end within a reference."""
    cut = "The&amp;&amp;&amp; and &lt;that&gt;&amp;"
    page = "<html><head><title>{0}</title><meta charset=utf-8></head><body><h1>{0}</h1><p>x &amp; y</p></body></html>"
    spark.createDataFrame([(i, "http://a.b/c", page.format(cut[: len(cut) - i])) for i in range(8)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert values(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == values(c.sql(ORACLE[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) == set(queries.QUERIES)


def test_api_reads_files(spark):
    from foliospark import api

    own = files(spark, {k: v for k, v in MEMBERS.items() if k in ("d/set.zip", "d/typed.docx", "d/scan.docx", "d/pic.png")} | {"d/seal.png": SMALL})
    each = {r["doc_id"]: r for r in api.read_all(own, {"n": "a number"}, client_factory=Fake).collect()}
    assert set(each) == {"d/set.zip#0", "d/set.zip#1", "d/typed.docx", "d/scan.docx", "d/pic.png", "d/seal.png"}
    assert all(r["ok"] for r in each.values()) and each["d/seal.png"]["images_sent"] == 1  # its own page, as the filter drops it
    whole = {r["doc_id"]: r["images_sent"] for r in api.read_files(own, prompt="x", client_factory=Fake).collect()}
    assert whole == {"d/set.zip": 1, "d/typed.docx": 0, "d/scan.docx": 1, "d/pic.png": 1, "d/seal.png": 1}
    assert all(hasattr(api, n) for n in api.__all__)


def test_images_that_cannot_be_converted_stay(docs):
    ready = prepare_all(docs, render_fallback=False)
    out = {r["doc_id"]: r for r in payload.with_sendable_images(ready, max_edge=100).collect()}
    assert set(out) == {r["doc_id"] for r in ready.collect()}
    kept = out["d/scan.docx"]["kept"][0]
    held = {b["sha256"]: bytes(b["data"]) for b in out["d/scan.docx"]["blobs"]}
    assert kept["sha256"] in held
    try:
        import PIL  # noqa: F401
    except ImportError:
        assert held[kept["sha256"]] == SCAN
