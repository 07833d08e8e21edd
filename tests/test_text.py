import math
import random
import warnings
from collections import Counter

from pyspark.sql import functions as F

from gridloom.functions import parsing as G, text as X
from gridloom.functions.calls import call_parts
from gridloom.functions.numbers import fixed, half_even
from gridloom.operators import bleu as L, messages as T
from gridloom.plans import all_queries
from gridloom.sources import files as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_fixed_point_text_rounds_like_the_binary_value(spark):
    values = [0.0625, 0.125, 1.005, 2.675, 0.5, 1.5, 2.5, 1234567.891, 0.0, -0.125, 0.855]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 2, 3):
        got = [r.t for r in df.select(fixed(F.col("v"), places).alias("t")).collect()]
        assert got == [f"{v:.{places}f}" for v in values]
    assert one(spark, half_even(F.lit(0.03125))) == round(0.03125, 4)


def boxes(spark, text, mode="strict"):
    row = G.parse_boxes(spark.createDataFrame([(text,)], "t string"), "t", mode).first()
    return row.n_boxes, [tuple(b)[1:] for b in row.boxes]


def test_box_lists_are_read_whole_or_not_at_all(spark):
    good = '[{"bbox": [0.1, 0.2, 1.5, "0.4"]}, 5, {"bbox": [1, 2]}, {"bbox": [0.5, 0.5, 0.5, 0.9]}]'
    assert boxes(spark, "see " + good + " ok") == (1, [(0.1, 0.2, 1.0, 0.4)])
    for bad in (good + " and [1]", '{"v":[{"bbox":[0,0,1,1]}]} and [2]', "[1], [2]", '[{"bbox": [0,0,1,1]}], "w": [1]', "none", ""):
        assert boxes(spark, bad)[0] == 0
    assert boxes(spark, '[{"bbox": [0.1, 0.2, 1.5, 0.1]}]', "perception") == (1, [(0.1, 0.2, 1.5, 0.1)])
    assert boxes(spark, '[{"bbox": [0, 0, 1, 1]}, {"bbox": [0, "x", 1, 1]}]', "perception") == (0, [])
    assert boxes(spark, 'so [0.1, 0.2, 0.3, 0.4] and [1, 2, 3, 4]', "lenient")[0] == 2


def call(spark, text):
    return G.parse_tool_calls(spark.createDataFrame([(text,)], "t string"), "t").first()


def test_tool_calls(spark):
    wrap = "<|tool_call_start|>[{}]<|tool_call_end|>".format
    r = call(spark, wrap('flag_for_review(reason="a \\"b\\", (c)", n=3)') + "why<|im_end|>rest")
    assert (r.action, r.outcome, r.reason) == ("flag", "ok", 'a "b", (c) — why')
    r = call(spark, wrap("request_neighbor_tile(direction='north')"))
    assert (r.action, r.reason, r.direction) == ("request_neighbor", "direction=north", "north")
    assert call(spark, wrap("discard()")).reason == "(no reason given)"
    assert [call(spark, t).outcome for t in (wrap("discard("), wrap("x.y()"), wrap("jump()"), "discard()")] == ["unparseable", "unparseable", "unknown_tool", "no_tool_call"]
    assert one(spark, G.lenient_tool(F.lit('go: discard(reason="a")<|im_end|>'))) == "discard"
    assert one(spark, G.lenient_tool(F.lit("nothing"))) == "<no_call>"


def test_json_actions(spark):
    df = spark.createDataFrame([('x {"action": "DOWNLINK ", "reason": " r ", "direction": "east"} y',), ('{"action": 5}',), ("{bad}",), ("}{",), ('{"reason": "r"}',)], "t string")
    rows = G.parse_json_actions(df, "t").collect()
    assert [(r.action, r.outcome) for r in rows] == [("downlink", "ok"), ("discard", "invalid_action"), ("discard", "json_decode_error"), ("discard", "no_json"), ("discard", "invalid_action")]
    assert rows[0].reason == "[east] r"
    assert [r.action for r in G.parse_json_actions(df, "t", "eval").collect()] == ["DOWNLINK ", "5", "<unparseable>", "<unparseable>", "<no_action_field>"]


def test_regions_and_sizes(spark):
    assert one(spark, X.centroid_region(F.lit(0.33), F.lit(0.67))) == "center of the scene"
    assert one(spark, X.centroid_region(F.lit(0.32), F.lit(0.68))) == "lower-left quadrant"
    assert one(spark, X.centroid_region(F.lit(0.5), F.lit(0.1))) == "upper portion of the scene"


def test_rich_prompt_has_priors_and_neighbours(spark):
    p = X.tile_prompt(F.lit("t1"), F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(0), F.lit(0.0), F.lit(" d "), F.lit(0.0), F.lit(1), F.lit(2), F.lit("p"), F.lit("{}"))
    assert one(spark, p) == (
        'Tile t1 at lon=1.0000, lat=2.0000.\nCloud cover: n/a. Captured: unknown.\n\nVLM detection:\n- 0 mining-pit candidate bounding box(es)\n- Description: "d"\n'
        "- Derived confidence: 0.00\n\nMission priors: p\nNeighbor summary (structured):\n{}\n\nPass budget: 1 KB of 2 KB remaining.\n\nChoose the appropriate tool."
    )


def brute_bleu(pairs):
    correct, total, pl, gl = [0] * 4, [0] * 4, 0, 0
    for p, g in pairs:
        p, g = p.split(), g.split()
        pl, gl = pl + len(p), gl + len(g)
        for n in range(1, 5):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, g))
            correct[n - 1] += sum(min(c, b[k]) for k, c in a.items())
            total[n - 1] += sum(a.values())
    if not any(correct) or 0 in total:
        return 0.0
    smooth, logs = 1.0, 0.0
    for c, t in zip(correct, total):
        if c == 0:
            smooth *= 2
        logs += math.log(100 * c / t if c else 100 / (smooth * t))
    return (1.0 if pl >= gl else math.exp(1 - gl / pl)) * math.exp(logs / 4)


def test_bleu_against_brute_force(spark):
    sets = [
        [("the cat sat on the mat today", "the cat sat on a mat today ok"), ("a b", "a b c"), ("", "x")],
        [("a b c d e", "e d c b a"), ("p q r s", "p q z z")],
        [("a", "b")], [("one two three", "one two three")],
    ]
    for pairs in sets:
        df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "k long, p string, g string")
        assert abs(L.corpus_bleu(df, "k", "p", "g", tokenize="none").first().bleu - brute_bleu(pairs)) < 1e-9


def test_13a_tokens(spark):
    got = one(spark, L.tokens(F.lit('He said, "3.5-fold" (1,000.) &amp; co-\nop.')))
    assert got == ["He", "said", ",", '"', "3.5", "-", "fold", '"', "(", "1,000", ".", ")", "&", "coop", "."]


def test_targets_are_json(spark):
    import json

    b = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c)]) for c in ((0.0, 0.0001, 0.5, 1.0), (0.1, 0.25, 0.0312, 0.9))])
    assert one(spark, T.grounding_target(b)) == json.dumps([{"label": "mining_pit", "bbox": [0.0, 0.0001, 0.5, 1.0]}, {"label": "mining_pit", "bbox": [0.1, 0.25, 0.0312, 0.9]}])
    made = one(spark, T.action_target(F.lit("discard"), F.lit(""), F.lit('say "hi"\n\\')))
    assert json.loads(made) == {"action": "discard", "reason": 'say "hi"\n\\'}


def test_patch_names(spark):
    names = ["a/IMAGE_AB_17_2016.tif", "AB_5_2022", "x_-1_2016.tif", "x_y_2016.tif", "AB_5_2019.tif", "5_2016"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.p for r in df.select(G.patch_num(F.col("path")).alias("p")).collect()] == [17, 5, -1, None, None, None]


def test_geojson_document(spark, tmp_path):
    doc = (
        '{"type": "FeatureCollection", "features": [\n {"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [0, 0]]]}},\n'
        ' {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 1]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": []}}]}'
    )
    (tmp_path / "s.geojson").write_text(doc)
    rows = S.read_site_vertices(spark, str(tmp_path), collection=True).collect()
    assert [(r.site_id, r.lon, r.lat) for r in rows] == [("0", 0.0, 0.0), ("0", 2.0, 0.0), ("0", 0.0, 0.0)]


def test_bleu_keeps_null_groups_and_counts_blanks(spark):
    df = spark.createDataFrame([(1, None, "a b c d", "a b c d"), (2, None, " ", "x"), (3, "en", "q", "q")], "k long, lang string, p string, g string")
    out = {r.lang: r for r in L.corpus_bleu(df, "k", "p", "g", ["lang"], "none").collect()}
    assert set(out) == {None, "en"} and (out[None].n_empty, out[None].n_pairs) == (1, 2) and abs(out[None].bleu - 100 * math.exp(1 - 5 / 4)) < 1e-9


def test_calls_as_the_interpreter_reads_them(spark):
    def made(call):
        df = spark.createDataFrame([(f"<|tool_call_start|>[{call}]<|tool_call_end|>",)], "t string")
        r = G.parse_tool_calls(df, "t").first()
        return r.tool, r.reason, r.direction

    for call, want in {
        'flag_for_review(reason="a", boxes=[1,2])': ("flag_for_review", "a", None),
        'discard(reason="x", "y")': None,
        'discard(reason="x", reason="y")': None,
        "discard(reason=5)": ("discard", "5", None),
        """downlink_now(note="a, reason='q'", reason="r")""": ("downlink_now", "r", None),
        """discard("x", reason="a" 'b')""": ("discard", "ab", None),
        "discard(reason=None)": ("discard", "None", None),
        'discard(opts={"a": [1, 2], "b": (3,)}, reason="ok")': ("discard", "ok", None),
        'request_neighbor_tile(direction="east", reason="z",)': ("request_neighbor_tile", "[east] z", "east"),
        'request_neighbor_tile(direction=None, reason="z")': ("request_neighbor_tile", "z", None),
    }.items():
        got = made(call)
        assert got == want if want else got[0] == "(unparseable)", call


def test_json_nulls_and_doubled_keys(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(['{"action":"flag","action":"downlink"}', '{"action": null}', '{"action":"flag","reason":null}', '{"action":"flag"}'])], "i int, t string")
    got = [(r.tool, r.reason) for r in G.parse_json_actions(df, "t").orderBy("i").collect()]
    assert [g[0] for g in got] == ["downlink", "(invalid_action:none)", "flag", "flag"] and [g[1] for g in got[2:]] == ["None", "(no reason given)"]


def test_bleu_counts_pairs_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "a b c d", "w x y z"), (1, "w x y z", "a b c d")], "k long, p string, g string")
    assert L.corpus_bleu(df, "k", "p", "g", tokenize="none").first().bleu == 0.0


def test_calls_of_any_length_and_depth(spark):
    """What would end the JVM or a worker as a pattern: a megabyte, brackets ten thousand deep, runs of blanks and words."""
    mark = "<|tool_call_start|>[{}]<|tool_call_end|>".format
    texts = [
        mark('flag_for_review(reason="' + "a\\n" * 300_000 + '")'), mark("discard(x=" + "[" * 10_000 + "]" * 10_000 + ")"), mark("discard(x=" + "-" * 50_000 + "1)"),
        mark("discard(" + " " * 200_000 + ")") + " " * 200_000 + "end", mark("discard(reason=" + "9" * 5000 + ")"), mark("discard(reason='\\ud800')"), mark("discard(x={[1]: 2})"), mark("a\x00b()"),
    ]
    rows = G.parse_tool_calls(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert rows[0].reason == ("a\n" * 300_000).strip() and rows[1].outcome == "unparseable" and rows[2].outcome in ("ok", "unparseable")
    assert [r.outcome for r in rows[3:]] == ["ok", "unparseable", "ok", "ok", "unparseable"] and rows[3].reason == "end" and rows[5].reason == "?"
    bare = spark.createDataFrame([("x" * 300_000,), ("w" * 200_000 + " discard (reason)",), (" " * 200_000 + "discard()",), (None,)], "t string")
    assert [r.n for r in bare.select(G.lenient_tool(F.col("t")).alias("n")).collect()] == ["<no_call>", "discard", "discard", "<no_call>"]


def test_calls_against_the_grammar():
    """Random argument lists: a call is read if and only if Python can compile it, and literals print as Python prints them."""
    rng = random.Random(7)
    atoms = ["1", "-2.5", "'a'", '"b\\n"', "'x' 'y'", "None", "True", "name", "f'{z}'", "1 + 1", "r'\\d'", "b'q'", "...", "lambda: 0", "(1,)", "[]", "{}", "{1, 2}", "'", "[", ")", "a b"]

    def some(depth):
        if depth and rng.random() < 0.4:
            inner = [some(depth - 1) for _ in range(rng.randint(0, 3))]
            return rng.choice(["[{}]", "({})", "{{{}}}"]).format(", ".join(inner))
        return rng.choice(atoms[:-4] if rng.random() < 0.95 else atoms)

    read = 0
    for _ in range(2000):
        keys = [rng.choice(["reason=", "direction=", "n=", "", "*", "**"]) for _ in range(rng.randint(0, 4))]
        text = "tool(" + ", ".join(k + some(2) for k in keys) + rng.choice(["", ","]) + ")"
        got = call_parts(text)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "t", "eval")
        except (SyntaxError, ValueError):
            assert got is None, text
            continue
        assert got is not None and got["name"] == "tool", text
        read += 1
    assert read > 300


def test_output_hygiene_parses_answers_once(spark):
    out = all_queries.QUERIES["output_hygiene"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    row = out.first()
    assert row.n_parseable + row.n_unparseable == row.n > 0


def test_empty_counts_equal_those_of_bleu_and_need_no_python(spark):
    rows = [("a", " \n", "x"), ("a", "y", "y"), ("a", None, "y"), ("b", "", ""), ("b", " z ", "z")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, lang string, pred string, gold string")
    got = {tuple(r) for r in L.empty_counts(df, "pred", ["lang"]).collect()}
    want = {tuple(r) for r in L.bleu_counts(df, "k", "pred", "gold", ["lang"]).select("lang", "n_empty", "n_pairs").collect()}
    assert got == want == {("a", 2, 3), ("b", 1, 2)}
    plan = all_queries.QUERIES["empty_outputs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_words_of_a_worker_are_the_tokens_of_the_columns(spark):
    r = random.Random(4)
    parts = ["a", "Ü", "7", "12", ".", ",", "-", "..", ", .", " ", "  ", "\n", "-\n", "\t", "\x1c", "\x85", "\xa0", " ", "​", "&amp;", "&quot;", "<skipped>", "'", "(", "~", "é!", "\U0001f600", "$1", "\\", "_", "/"]
    texts = ["", " ", *["".join(r.choices(parts, k=r.randrange(1, 25))) for _ in range(1500)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for how in ("13a", "none"):
        words = L._words(how)
        for row in df.select("t", L.tokens(F.col("t"), how).alias("want")).collect():
            assert words(row.t) == row.want, row.t
    counts = L.bleu_counts(df.withColumn("p", F.lower("t")), "t", "p", "t")
    assert "regexp_replace" not in counts._jdf.queryExecution().toString()
