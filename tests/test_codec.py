"""Files, streams, SQL functions and the command line around the codec."""

import numpy as np
from pyspark.sql import functions as F

from tests_pictures import synthetic
from tessera.operators.planes import RATIOS
from tessera.plans import codec
from tessera.plans import kernel as K
from tessera.plans.queries import picture_payload
from tessera.sources import pixels as X
from tessera.sources.images import images_of, png, read_containers, read_images, write_files, write_png, write_split
from tessera.streaming.containers import container_stream, decode_stream, encode_stream, image_table_stream


def table(spark, n=3):
    return spark.createDataFrame([(i, 20 + i, 18, "rgb", bytearray(synthetic(20 + i, 18).astype(np.uint8).tobytes())) for i in range(n)], "img_id long, w int, h int, kind string, data binary")


def test_relational_equals_arrow(spark):
    e = codec.encode(images_of(X.synthetic(spark, 33, 21)), 20, keep_payload=True).first()
    assert picture_payload(X.synthetic(spark, 33, 21), 20, 33, 21).first().payload_hex == bytes(e.payload).hex().upper()


def test_error_rows(spark):
    bad = spark.createDataFrame([(1, 4, 4, "rgb", bytearray(5)), (2, None, 4, "rgb", bytearray(5)), (3, 2, 2, "rgb", bytearray(12)), (4, 8, 8, "what", bytearray(1))], "img_id long, w int, h int, kind string, data binary")
    rows = {r.img_id: r.error for r in codec.encode(bad, 0).collect()}
    assert set(rows) == {1, 2, 3, 4} and all(rows.values())
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray())], "img_id long, compressed binary")
    assert all(r.error for r in codec.decode(broken).collect())
    assert codec.encode(bad.limit(0)).count() == 0


def test_kinds():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    for ratio, (fx, fy) in RATIOS.items():
        c = rng.integers(0, 256, (2, -(-5 // fy), -(-7 // fx)), dtype=np.uint8)
        got = codec.planes_of(y.tobytes() + c.tobytes(), 7, 5, f"ycbcr{ratio}", False)
        assert (got[0] == y).all() and all(got[1 + k][j, i] == c[k, j // fy, i // fx] for k in range(2) for j in range(5) for i in range(7))
    wide = rng.integers(0, 65536, (5, 7, 4)).astype(">u2")
    cut = (wide[..., :3].astype(np.int64) * wide[..., 3:] // 65535) >> 8
    assert all((a == b).all() for a, b in zip(codec.planes_of(wide.tobytes(), 7, 5, "rgba16", False), K.planes(cut), strict=True))
    assert len(codec.planes_of(y.tobytes(), 7, 5, "gray", True)) == 1


def test_files(spark, tmp_path):
    pictures, containers, out = tmp_path / "p", tmp_path / "c", tmp_path / "o"
    pictures.mkdir()
    img = synthetic(30, 22).astype(np.uint8)
    (pictures / "a.png").write_bytes(png(img))
    read = read_images(spark, str(pictures))
    row = read.first()
    assert (row.w, row.h, row.kind) == (30, 22, "rgb") and bytes(row.data) == img.tobytes()
    e = codec.encode(read, 80)
    write_files(e.select(F.lit("a.btc").alias("n"), "compressed"), str(containers), "n", "compressed")
    d = codec.decode(read_containers(spark, str(containers), "*.btc"))
    assert bytes(d.first().data) == K.decode(K.encode(K.planes(img), 80)).tobytes()
    write_png(d, str(out))
    write_split(d, str(out))
    assert len([p for p in out.iterdir() if p.suffix == ".png"]) == 4
    assert bytes(read_images(spark, str(next(p for p in out.iterdir() if "_" not in p.name))).first().data) == bytes(d.first().data)
    r = codec.report(e, read.select("img_id", F.length("data").alias("in_size"))).first()
    assert r.ratio == r.out_size / r.in_size and r.size_text.endswith("KB")


def test_streams(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "in"))
    encode_stream(image_table_stream(spark, str(tmp_path / "in")), str(tmp_path / "enc"), str(tmp_path / "k1"), 40).awaitTermination()
    batch = {r.img_id: bytes(r.compressed) for r in codec.encode(table(spark), 40).collect()}
    assert {r.img_id: bytes(r.compressed) for r in spark.read.parquet(str(tmp_path / "enc")).collect()} == batch
    write_files(spark.read.parquet(str(tmp_path / "enc")).select(F.col("img_id").cast("string").alias("n"), "compressed"), str(tmp_path / "files"), "n", "compressed")
    decode_stream(container_stream(spark, str(tmp_path / "files"), "[0-9]*"), str(tmp_path / "dec"), str(tmp_path / "k2"), True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dec")).where("error is null").count() == 3


def test_sql_functions(spark):
    codec.register(spark)
    table(spark).createOrReplaceTempView("pictures")
    r = spark.sql("SELECT img_id, codec_decode(codec_encode(data, w, h, kind, 70, false), false) AS d FROM pictures").collect()
    for row in r:
        want = K.decode(K.encode(K.planes(synthetic(20 + row.img_id, 18)), 70))
        assert bytes(row.d.data) == want.tobytes()
    p = K.encode(K.planes(synthetic(20, 18)), 70)
    s = spark.sql(f"SELECT * FROM codec_segments(X'{p.hex()}')").collect()
    assert [x.ch for x in s] == [0, 1, 2]


def draw(spark, kind, path, w=24, h=18, alpha=False):
    """A picture file made by the JVM's own writers."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, 2 if alpha else 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, ((x * 9 & 255) << 24 if alpha else 0) - (1 << 32 if alpha and x * 9 & 128 else 0) | (x * 10) << 16 | (y * 13) << 8 | (x + y))
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_picture_formats_and_bad_files(spark, tmp_path):
    for kind in ("jpg", "gif", "png", "bmp"):
        draw(spark, kind, tmp_path / f"a.{kind}")
    draw(spark, "png", tmp_path / "alpha.png", alpha=True)
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    read = read_images(spark, str(tmp_path))
    rows = {r.origin.rpartition("/")[2]: r for r in read.collect()}
    assert len(rows) == 6 and rows["broken.png"].data is None and rows["alpha.png"].kind == "nrgba"
    exact = bytes(rows["a.png"].data)
    assert all((r.w, r.h) == (24, 18) for n, r in rows.items() if n != "broken.png") and exact[3:6] == bytes([10, 0, 1])
    assert bytes(rows["a.bmp"].data) == exact
    near = np.abs(np.frombuffer(bytes(rows["a.jpg"].data), dtype=np.uint8).astype(int) - np.frombuffer(exact, dtype=np.uint8))
    assert near.mean() < 8
    e = {r.img_id: r for r in codec.encode(read, 80, keep_payload=True).collect()}
    assert sum(r.error is not None for r in e.values()) == 1 and e[rows["broken.png"].img_id].error == "no image"
    # alpha is ignored, not multiplied
    straight = np.frombuffer(bytes(rows["alpha.png"].data), dtype=np.uint8).reshape(18, 24, 4)[..., :3]
    assert bytes(e[rows["alpha.png"].img_id].payload) == K.encode(K.planes(straight), 80)


def test_one_partition_or_many(spark):
    images = table(spark, 9)
    one = codec.encode(images.coalesce(1), 60)
    many = codec.encode(images.repartition(7), 60)
    key = lambda df: sorted((r.img_id, bytes(r.compressed)) for r in df.collect())
    assert key(one) == key(many)
    assert sorted(map(tuple, codec.decode(one.coalesce(1), True).collect())) == sorted(map(tuple, codec.decode(many.repartition(5), True).collect()))


def test_relational_decode_of_many_sizes(spark):
    """Pictures of several sizes, one of them long, in one plan; blocks and offsets cross the parts of a channel."""
    from tessera.operators import blocks as B
    from tessera.operators import decode as D
    from tessera.operators import prefix

    sizes = [(1, 20, 18), (2, 33, 7), (3, 3, 40), (4, 130, 90)]
    images = spark.createDataFrame([(i, w, h, "rgb", bytearray(synthetic(w, h).astype(np.uint8).tobytes())) for i, w, h in sizes], "img_id long, w int, h int, kind string, data binary")
    encoded = codec.encode(images, 40, keep_payload=True)
    old, prefix.PART = prefix.PART, 64
    try:
        got = D.planes_of(D.blocks_of(codec.streams_of(codec.parse(encoded.select("img_id", "payload"))))).collect()
    finally:
        prefix.PART = old
    planes = {}
    for r in got:
        planes.setdefault((r.img_id, r.ch), {})[r.x, r.y] = r.v
    for r in encoded.collect():
        head, chans = K.split(bytes(r.payload))
        w4, h4, _, _ = K.layout(r.w, r.h, head["small"], head["macro"])
        for ch, s in chans.items():
            want = K.decode_plane(s, head, 0)
            assert planes[r.img_id, ch] == {(x, y): int(want[y, x]) for y in range(h4) for x in range(w4)}
    assert B.sizes_of(X.synthetic(spark, 5, 4)).first().w == 5


def test_command_line(spark, tmp_path, capsys):
    import pytest

    from tessera.__main__ import main

    draw(spark, "png", tmp_path / "one.png")
    (tmp_path / "bad.png").write_bytes(b"no")
    main([str(tmp_path / "*.png"), "60"], spark)
    assert "no image" in capsys.readouterr().out and (tmp_path / "one.btc").exists() and not (tmp_path / "bad.btc").exists()
    main([str(tmp_path / "one.png"), "80", "bw", str(tmp_path / "back" / "b.png"), "-out", str(tmp_path / "o")], spark)
    assert (tmp_path / "o" / "one.btc").exists()
    gray = read_images(spark, str(tmp_path / "back" / "b.png")).first()
    px = np.frombuffer(bytes(gray.data), dtype=np.uint8).reshape(-1, 3)
    assert (px[:, 0] == px[:, 1]).all() and (px[:, 1] == px[:, 2]).all()
    main([str(tmp_path / "one.btc"), "-postfilter", "-out", str(tmp_path / "d")], spark)
    assert (tmp_path / "d" / "one.png").exists() and "one.btc" in capsys.readouterr().out
    main([str(tmp_path / "one.btc"), "-split", "-out", str(tmp_path / "s")], spark)
    assert {p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")} == {f"one_{c}.png" for c in ("Y", "Cb", "Cr")}
    for wrong in (["x.png", "101"], ["x.png", "seven"], ["x.png", "50", "gray"], []):
        with pytest.raises(SystemExit):
            main(wrong, spark)


def odd_texts(spark, folder):
    """A folder with documents of many lengths: null, empty, one line, lines that aren't full, and one that is long."""
    texts = [None, "", "a", "b" * 32, "c" * 33, "d\U0001f600é" * 40, *("".join(chr(32 + (i * j * j + j // 7) % 90) for j in range(37 * i)) for i in range(1, 12)), "long line " * 3500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_documents_decoded_as_relations(spark, tmp_path):
    """Many pictures to payloads and back with a row a pixel give the sums of the Arrow path, in whose plan no row is a pixel."""
    from tessera.functions.presets import preset
    from tessera.operators import blocks as B
    from tessera.operators import decode as D
    from tessera.operators import streams as S
    from tessera.operators.planes import planes_gray
    from tessera.plans.queries import decode_documents
    from tessera.plans.tables import materialize

    sf = odd_texts(spark, tmp_path)
    px = X.documents(spark, sf)
    sizes = B.sizes_of(px)
    blocks = materialize(B.encode_blocks(B.with_size(planes_gray(px, bw=True), sizes), *preset(40)), "blocks")
    p = materialize(S.payloads(blocks, sizes, *preset(40)[:2], bw=True), "payloads")
    v = D.planes_of(D.blocks_of(codec.streams_of(materialize(codec.parse(p.select("img_id", F.unhex("payload_hex").alias("payload"))), "parsed"))))
    want = v.groupBy("img_id").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.sum((F.col("v") * (F.col("x") + 1) * (F.col("y") % 1000 + 1)).cast("long")).alias("weighted"))
    got = decode_documents(spark, sf)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 14


def test_documents_filtered_as_relations(spark, tmp_path):
    """The post-filter with a row a pixel gives the sums of the Arrow path, in whose plan no row is a pixel."""
    from tessera.plans.queries import filtered, postfilter_documents

    sf = odd_texts(spark, tmp_path)
    v = F.col("v")
    f = filtered(X.documents(spark, sf).select("img_id", "x", "y", v.alias("r"), v.alias("g"), v.alias("b")), 4)
    want = f.groupBy("img_id").agg(F.count("r").alias("n"), F.sum("r").alias("total"), F.sum((F.col("r") * (F.col("x") + 1) * (F.col("y") % 1000 + 1)).cast("long")).alias("weighted"))
    got = postfilter_documents(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 16


def test_stacked_pictures_are_filtered_apart():
    rng = np.random.default_rng(1)
    for small in (2, 3, 4):
        for w in (5, 8, 32):
            heights = np.array([1, 7, 8, 9, 2 * small - 1, 40, 13, 8, 1])
            img = (rng.integers(0, 12, (heights.sum(), w, 3)) + 100).astype(np.uint8)
            ends = np.cumsum(heights)
            got = K.deblocked(img, small, heights)
            assert (got == np.concatenate([K.deblocked(img[b - n : b], small) for n, b in zip(heights, ends, strict=True)])).all()
            gray = np.repeat(img[..., :1], 3, axis=-1)
            assert (K.deblocked(gray, small, heights)[..., :1] == K.deblocked(img[..., :1], small, heights)).all()


def test_few_images_at_once(spark, tmp_path):
    """However many texts a batch has, Python holds the images of some; texts to rows of errors in one Python worker."""
    import tracemalloc

    import pyarrow as pa

    from tessera.plans.queries import encode_documents, encode_too_small
    from tessera.plans.tables import SLICE_BYTES, SLICE_ROWS, slices
    from tessera.sources.images import text_images

    texts = ["x" * 3000] * 4000 + [None, "", "y" * (3 * SLICE_BYTES), "z"]
    batch = pa.RecordBatch.from_pydict({"img_id": range(len(texts)), "text": texts}, schema=pa.schema([("img_id", pa.int64()), ("text", pa.string())]))
    parts = list(slices(iter([batch])))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(p.num_rows <= SLICE_ROWS and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= SLICE_BYTES) for p in parts)
    small = batch.slice(0, 4000)
    tracemalloc.start()
    assert sum(b.num_rows for b in codec.encoder(0, bw=True)(text_images(iter([small])))) == 4000
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    sf = odd_texts(spark, tmp_path)
    for q in (encode_too_small, encode_documents):
        assert q(spark, sf)._jdf.queryExecution().executedPlan().toString().split().count("MapInArrow") == 1
