"""Tokenizer rules on hand-made vocabularies."""

from pyspark.sql import functions as F

from framelake.functions import prompts as pr
from framelake.functions import tokens as tk


def vocab(spark, pairs):
    return spark.createDataFrame(pairs, "token string, id long")


def test_encode_whole_words_bytes_and_bos(spark):
    v = vocab(spark, [("hello", 5000), ("h", 8), ("e", 5), ("l", 12), ("o", 15), (",", 60)])
    docs = spark.createDataFrame([(1, "hello  héllo,\tx"), (2, "   "), (3, "")], "id long, text string")
    got = {r.id: r.input_ids for r in tk.tokenize(docs, v, "id").collect()}
    # h, é (2 UTF-8 bytes -> 100, 100), l, l, o, ','  ; x has no 1-char entry -> 100
    assert got[1] == [tk.BOS_ID, 5000, 8, 100, 100, 12, 12, 15, 60, 100]
    assert got[2] == [] and got[3] == []
    nobos = {r.id: r.input_ids for r in tk.tokenize(docs, v, "id", add_special=False).collect()}
    assert nobos[1][0] == 5000


def test_fallback_and_bytes(spark):
    df = spark.createDataFrame([("a b\tç~",)], "t string")
    r = df.select(tk.tokenize_fallback(F.col("t")).alias("f"), tk.signed_bytes(F.lit("é")).alias("b"),
                  tk.ascii_padded(F.lit("hé")).alias("a"), tk.prompt_bytes_512(F.lit("A")).alias("p"),
                  tk.pad_or_truncate(F.array(F.lit(1).cast("long")), 3, 220).alias("pad"),
                  tk.truncate_tokens(F.array(*[F.lit(i).cast("long") for i in range(5)]), 2).alias("tr")).first()
    assert r.f == [1097, 220, 1098, 1126]
    assert r.b == [-61, -87]
    assert r.a[:3] == [104, 32, 32] and len(r.a) == 16
    assert r.p[0] == 65 and len(r.p) == 512 and set(r.p[1:]) == {0}
    assert r.pad == [1, 220, 220] and r.tr == [0, 1]


def test_decode_rules(spark):
    v = vocab(spark, [("hi", 8), ("Ġworld", 7), ("x", 9)])
    rows = spark.createDataFrame([(1, [8, 7, tk.BOS_ID, 99999, 42]), (2, [7, 9]), (3, [tk.IMAGE_ID])],
                                 "id long, input_ids array<bigint>")
    got = {r.id: r.text for r in tk.detokenize(rows, v, "id").collect()}
    assert got[1] == "hi world<unk>[42]"
    assert got[2] == "worldx"          # leading marker on empty output adds no space
    assert got[3] == ""
    keep = {r.id: r.text for r in tk.detokenize(rows, v, "id", skip_special=False).collect()}
    assert keep[3] == "<|image|>"


def test_special_token_helpers(spark):
    r = spark.range(1).select(
        tk.is_special(F.lit(tk.VIDEO_ID)).alias("s"), tk.is_special(F.lit(5)).alias("n"),
        tk.strip_special(F.array(*[F.lit(x).cast("long") for x in (1, tk.BOS_ID, 1)])).alias("st"),
        tk.string_to_token(F.lit("<|im_end|>"), F.lit(None).cast("long")).alias("sid"),
        tk.string_to_token(F.lit("zzz"), F.lit(None).cast("long")).alias("miss")).first()
    assert r.s and not r.n and r.st == [1, 1] and r.sid == tk.EOS_ID and r.miss == -1


def test_chat_template_media_numbers_and_defaults(spark):
    parts = spark.createDataFrame([
        (1, 0, "user", 0, "image", None), (1, 0, "user", 1, "text", "look"),
        (1, 1, "assistant", 0, "text", "ok"), (1, 2, "user", 0, "image", None),
        (1, 2, "user", 1, "video", None), (1, 3, "tool", 0, "text", "dropped"),
        (2, 0, "system", 0, "text", "S"), (2, 1, "user", 0, "text", "q")],
        "conv_id long, turn long, role string, ppos int, kind string, text string")
    got = {r.conv_id: r.text for r in pr.chat_template(parts).collect()}
    assert got[1] == ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
                      "<|im_start|>user\nPicture 1: <|vision_start|><|image_pad|><|vision_end|>look<|im_end|>\n"
                      "<|im_start|>assistant\nok<|im_end|>\n"
                      "<|im_start|>user\nPicture 2: <|vision_start|><|image_pad|><|vision_end|>"
                      "Video 1: <|vision_start|><|video_pad|><|vision_end|><|im_end|>\n"
                      "<|im_start|>assistant\n")
    assert got[2].startswith("<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq")


def test_model_input_positions(spark):
    ids = pr.vision_tokens(F.lit(1), F.lit(1))
    r = spark.range(1).select(pr.model_input(ids).alias("m")).first().m
    assert r.input_ids == [151652, 151655, 151653, 151652, 151656, 151653]
    assert r.image_positions == [1] and r.video_positions == [4] and r.sequence_length == 6
    e = spark.range(1).select(pr.positions(F.lit(0)).alias("p")).first().p
    assert e == []


def test_repeated_and_null_keys_stay_apart(spark):
    v = vocab(spark, [("a", 1), ("b", 2)])
    docs = spark.createDataFrame([(1, "a b"), (1, "b"), (None, "a"), (None, "b a"), (2**60 + 1, ""), (2**60 + 3, None)], "id long, text string")
    ids = tk.tokenize(docs, v, "id", add_special=False)
    assert sorted(((r.id, r.input_ids) for r in ids.collect()), key=str) == sorted(
        [(1, [1, 2]), (1, [2]), (None, [1]), (None, [2, 1]), (2**60 + 1, []), (2**60 + 3, [])], key=str)
    back = tk.detokenize(spark.createDataFrame([(1, [1, 2]), (1, [2]), (None, [1]), (None, [2])], "id long, input_ids array<bigint>"), v, "id")
    assert sorted(((r.id, r.text) for r in back.collect()), key=str) == sorted([(1, "ab"), (1, "b"), (None, "a"), (None, "b")], key=str)


def test_no_row_per_word_or_id_is_regrouped(spark):
    """Whole texts are encoded and decoded in their blocks, whatever the size of a row; the plan neither cuts texts into rows that it
    collects again nor loses the order. Vocabulary entries may repeat or be without id."""
    v = vocab(spark, [("a", 1), ("bb", 1000), ("bb", 900), ("cc", None), ("Ġd", 1001), (None, 1002)])
    long = "bb x " * 20_000
    texts = {k: "" if k % 7 == 0 else f"a\x0bbb a{k} cc é\x1c a" if k % 5 else None for k in range(300)} | {300: long, 301: "a"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2)
    char = lambda w: [1 if c == "a" else 100 for c in w.encode("latin-1", "replace").decode("latin-1") for _ in c.encode()]
    enc = lambda w: {"bb": [900, 1000], "a": [1]}.get(w) or char(w)
    want = {k: [tk.BOS_ID, *sum(map(enc, t.replace("\x0b", " ").split(" ")), [])] if t else [] for k, t in texts.items() if k != 300}
    want[300] = [tk.BOS_ID, *[900, 1000, 100] * 20_000]
    ids = tk.tokenize(docs, v, "id")
    assert {r.id: r.input_ids for r in ids.collect()} == want
    some = spark.createDataFrame([(1, [1001, None, 1001, 900, 7]), (2, None), (3, []), (4, [1, 1001, tk.BOS_ID, 1001, 1002])], "id long, input_ids array<bigint>")
    back = tk.detokenize(some.withColumn("c", F.col("id") * 2), v, "id", carry=("c",))
    assert {(r.id, r.c, r.text) for r in back.collect()} == {(1, 2, "d dbb[7]"), (2, 4, ""), (3, 6, ""), (4, 8, "a d d[1002]")}
    for df in (ids, back):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
