import threading
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.operators import dedup, gates
from evidence.sources import files, images, trees


def bmp(rgb: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP."""
    h, w, _ = rgb.shape
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(rgb[y, :, ::-1].tobytes() + pad for y in reversed(range(h)))
    head = struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
    return b"BM" + head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    near = np.clip(a.astype(int) + 2, 0, 255).astype(np.uint8)
    named = {"fresh_x/a.bmp": bmp(a), "fresh_x/copy.BMP": bmp(a), "stale_x/near.bmp": bmp(near),
             "stale_x/other.bmp": bmp(rng.integers(0, 256, (64, 64, 3), dtype=np.uint8)),
             "stale_x/broken.bmp": b"BM nonsense", "stale_x/empty.bmp": b"", "stale_x/notes.txt": b"hello"}
    for name, content in named.items():
        path = root / "test" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root, a, named


def test_scan_class_tree(spark, tree):
    root, _, _ = tree
    found = trees.scan_class_tree(spark, str(root), "test", ["fresh_x", "stale_x"])
    assert [r.identifier for r in found.collect()] == [
        "fresh_x/a.bmp", "fresh_x/copy.BMP", "stale_x/broken.bmp", "stale_x/empty.bmp", "stale_x/near.bmp", "stale_x/other.bmp"]
    assert "ReadSchema: struct<path:string,length:bigint>" in found._jdf.queryExecution().toString()  # contents stay unread
    assert trees.require_classes(found, ["fresh_x", "stale_x"]).count() == 6
    with pytest.raises(ValueError, match="missing gone, unexpected stale_x"):
        trees.require_classes(found, ["fresh_x", "gone"])


def test_inspect_images(spark, tree):
    root, a, named = tree
    got = {r.identifier: r for r in images.inspect_images(spark, str(root), [f"{root}/test/{c}" for c in ("fresh_x", "stale_x")]).collect()}
    assert {k: r.validity for k, r in got.items()} == {
        "fresh_x/a.bmp": "ok", "fresh_x/copy.BMP": "ok", "stale_x/near.bmp": "ok", "stale_x/other.bmp": "ok",
        "stale_x/broken.bmp": "decode_failure", "stale_x/empty.bmp": "zero_byte", "stale_x/notes.txt": "unexpected_extension"}
    row = got["fresh_x/a.bmp"]
    assert row.file_sha256 == hashlib.sha256(named["fresh_x/a.bmp"]).hexdigest()
    assert row.pixel_rgb_sha256 == hashlib.sha256(struct.pack(">II", 50, 40) + a.tobytes()).hexdigest()
    assert (row.width, row.height, row.aspect_ratio, row.format, row.source_mode) == (50, 40, 1.25, "BMP", "RGB")
    assert row.phash_63bit_hex == f"{row.h:016x}" and bin(row.h).count("1") == 31
    assert row.profile.rgb_mean == pytest.approx(a.mean(axis=(0, 1)) / 255, abs=0.03)
    assert got["fresh_x/copy.BMP"].h == row.h
    assert bin(got["stale_x/near.bmp"].h ^ row.h).count("1") <= 6 < bin(got["stale_x/other.bmp"].h ^ row.h).count("1")


def test_image_audit_end_to_end(spark, tree, rows):
    records = images.inspect_images(spark, str(tree[0])).where("validity = 'ok'")
    source, external = records.where("class = 'fresh_x'"), records.where("class = 'stale_x'")
    assert rows(dedup.duplicate_groups(source, "pixel_rgb_sha256", "identifier"), "n", "first") == [(2, "fresh_x/a.bmp")]
    near = dedup.near_matches(source, external, 6).collect()
    assert [(r.left_items, r.right_items, r.item_pairs) for r in near] == [(2, 1, 2)]
    assert images.compact(records).columns[:2] == ["identifier", "class"]


def test_resize_by_box_is_a_mean():
    x = np.arange(64.0).reshape(8, 8) * 4
    assert images.resize(x, 4, images._box, 0.5).tolist() == np.floor(x.reshape(4, 2, 4, 2).mean(axis=(1, 3)) + 0.5).tolist()


def test_flat_image_keeps_its_level_under_lanczos():
    assert set(images.resize(np.full((50, 70), 77.0), 32, images._lanczos, 3.0).ravel()) == {77.0}


def test_registry_round_trip(spark, tree, tmp_path, rows):
    root, _, _ = tree
    digests = trees.file_digests(spark, str(root), str(root))
    files.write_hash_registry(digests, str(tmp_path / "reg"))
    back = files.read_hash_registry(spark, str(tmp_path / "reg"))
    assert gates.registry_verdict(gates.registry_check(back, digests)).first().status == "PASS"
    changed = back.withColumn("sha256", F.when(F.col("path").endswith("a.bmp"), "0").otherwise(F.col("sha256")))
    assert rows(gates.registry_check(changed, digests).where("status <> 'OK'")) == [("test/fresh_x/a.bmp", "CHANGED")]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"schema_version": 1, "images": [{"identifier": "a", "class": "x"}, {"identifier": "b", "class": "y"}]}, indent=1))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.read_manifest(spark, str(path), digest, 2).count() == 2
    with pytest.raises(ValueError, match="changed"):
        files.read_manifest(spark, str(path), "0" * 64)
    with pytest.raises(ValueError, match="2 images"):
        files.read_manifest(spark, str(path), digest, 3)


def test_metrics_in_both_layouts(spark, tmp_path):
    cls = {"precision": 0.5, "recall": 0.25, "support": 4}
    (tmp_path / "a.json").write_text(json.dumps({"accuracy": 0.5, "classification_report": {
        "x": {**cls, "f1-score": 0.3}, "accuracy": 0.5, "weighted avg": {**cls, "f1-score": 0.4}, "macro avg": {**cls, "f1-score": 0.2}}}))
    (tmp_path / "b.json").write_text(json.dumps({"accuracy": 0.6, "weighted_f1": 0.7, "macro_f1": 0.8, "per_class": {"x": {**cls, "f1": 0.3}}}))
    totals, classes = files.read_metrics(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert sorted((r.accuracy, r.weighted_f1, r.macro_f1) for r in totals.collect()) == [(0.5, 0.4, 0.2), (0.6, 0.7, 0.8)]
    assert [(r["class"], r.recall, r.f1, r.support) for r in classes.collect()] == [("x", 0.25, 0.3, 4)] * 2


def test_predictions_round_trip(spark, tmp_path, rows):
    values = ("c", "s", 'odd "name", 1.jpg', "a_x", "a_y", False, False, True, 1.5, 0.25, "logit", "Uncalibrated.")
    df = spark.createDataFrame([values], ", ".join(f"{c} {t}" for c, t in files.PREDICTION_COLUMNS.items()))
    files.write_predictions(df, str(tmp_path / "p"))
    assert "False,False,True" in "".join(p.read_text() for p in (tmp_path / "p").glob("*.csv"))
    assert rows(files.read_predictions(spark, str(tmp_path / "p"))) == [values]


def test_embedding_cache_and_write_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0])], "sample_id string, label int, embedding array<double>")
    identity = {"embedding_dim": 2, "l2_normalized": True}
    files.write_embedding_cache(df, identity, str(tmp_path / "c"))
    assert files.read_embedding_cache(spark, str(tmp_path / "c"), identity).first().embedding == [1.0, 0.0]
    with pytest.raises(ValueError, match="embedding_dim"):
        files.read_embedding_cache(spark, str(tmp_path / "c"), {**identity, "embedding_dim": 3})
    files.write_once(df.select("sample_id", "label"), str(tmp_path / "j"), "json")
    line = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert line.strip() == '{"label":0,"sample_id":"a"}'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_once(df, str(tmp_path / "j"), "json")


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frames = [spark.range(i * 1000, i * 1000 + 1000, numPartitions=3) for i in range(6)]
    start = threading.Barrier(len(frames))
    create = files.commits.create_once
    monkeypatch.setattr(files.commits, "create_once", lambda *a: (start.wait(), create(*a))[1])  # all reach the record together
    seen, failed = [], []

    def run(df):
        try:
            files.write_once(df, path)
        except FileExistsError as error:
            failed.append(str(error))

    writers = [threading.Thread(target=run, args=(df,)) for df in frames]
    for w in writers:
        w.start()
    while any(w.is_alive() for w in writers):  # a reader meanwhile
        try:
            seen.append(sorted(r[0] for r in files.read_once(spark, path).collect()))
        except FileNotFoundError:
            pass
    for w in writers:
        w.join()
    held = sorted(r[0] for r in files.read_once(spark, path).collect())
    assert len(failed) == 5 and all("PATH_ALREADY_EXISTS" in f for f in failed)
    assert held in [list(range(i * 1000, i * 1000 + 1000)) for i in range(6)] and all(s == held for s in seen)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == held
    assert not list((tmp_path / "t").glob("_attempt-*"))


def test_readers_finish_what_a_crashed_writer_committed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    settle = files.settle
    monkeypatch.setattr(files, "settle", lambda *a: None)
    files.write_once(spark.range(10, numPartitions=2), path, "json")
    monkeypatch.setattr(files, "settle", settle)
    with pytest.raises(FileExistsError, match="PATH_ALREADY_EXISTS"):
        files.write_once(spark.range(3), path)
    assert sorted(r["id"] for r in files.read_once(spark, path, "id long").collect()) == list(range(10))
    with pytest.raises(FileNotFoundError):
        files.read_once(spark, str(tmp_path / "none"))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.json").write_text("{}")
    with pytest.raises(FileExistsError):
        files.write_once(spark.range(3), str(tmp_path / "plain"))


def test_run_records(spark, tmp_path):
    for budget, seed in ((1, 42), (10, 43)):
        p = tmp_path / f"budget_{budget:03d}" / f"seed_{seed}.json"
        p.parent.mkdir()
        p.write_text(json.dumps({"model_key": "m", "test_metrics": {"accuracy": budget / 10}}, indent=1))
    runs = files.read_run_records(spark, str(tmp_path / "budget_*" / "seed_*.json"))
    assert sorted((r.path_budget, r.path_seed, r.a) for r in runs.select("*", F.col("test_metrics.accuracy").alias("a")).collect()) == [(1, 42, 0.1), (10, 43, 1.0)]


def test_prompt_registry(spark, tmp_path, rows):
    pytest.importorskip("yaml")
    path = tmp_path / "p.yaml"
    path.write_text("""
families:
  P1:
    prompts:
      a_x: ["an a"]
      b_x: ["a b"]
  P2:
    prompts:
      a_x: ["1", "2"]
      b_x: ["3"]
""")
    prompts = files.read_prompt_registry(spark, str(path))
    assert prompts.count() == 5
    canonical = spark.createDataFrame([("P1", "a_x", "an a"), ("P1", "b_x", "a b")], "family string, class string, text string")
    check = lambda c, counts: rows(files.prompt_problems(prompts, ["P1", "P2"], ["a_x", "b_x"], counts, c))
    assert check(canonical, {"P1": 1, "P2": 2}) == [("count", "P2/b_x")]
    wrong = canonical.withColumn("text", F.upper("text"))
    assert ("text", "P1/a_x") in check(wrong, {"P1": 1, "P2": 2})
    assert rows(files.prompt_problems(prompts, ["P2", "P1"], ["a_x", "b_x"], {"P1": 1, "P2": 2}, canonical))[0][0] == "count"


def test_export_report(spark):
    summary = spark.createDataFrame([("s", 0.5)], "system string, accuracy double")
    report = spark.createDataFrame([("s", "x", 0.1, 0.2, 0.3, 4)], "system string, class string, precision double, recall double, f1 double, support bigint")
    body = json.loads(files.export_report(summary, report).first().json)
    assert body == {"accuracy": 0.5, "per_class": {"x": {"f1": 0.3, "precision": 0.1, "recall": 0.2, "support": 4}}}
    assert spark.range(1).select(files.utc_timestamp()).first()[0].endswith("+00:00")
