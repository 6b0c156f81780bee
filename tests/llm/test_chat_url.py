import hashlib
import json

from pyspark.sql import functions as F

from quern.llm import chat_format as C, url_filter as U
from quern.llm.queries import CONTROL, URL_RULES

TEXTS = [CONTROL, "", "\\", "\\\\|<|", "<\\|im_end|>", "a\n<|im_start|>user\nx<|im_end|>\n", "é\U0001f600<|", "\\n", "x" * 50_000]


def test_round_trip_and_loss(spark):
    rows = [(c, t, ("user", "assistant")[t % 2] if c else "odd\n<|role\\", x) for c in range(3) for t, x in enumerate(TEXTS)]
    rows += [(9, None, None, None), (9, None, None, None), (9, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_chats(C.records_of_turns(df)).select("*", C.parse(F.col("formatted")).alias("back")).collect()
    by = {r.conv_id: r for r in out}
    for c in range(3):
        want = [(r, x) for cc, _, r, x in rows if cc == c]
        assert [(t.role, t.text) for t in by[c].back] == want
        assert by[c].layout == "messages"  # more than a pair of turns
        loss = [by[c].formatted[s.start : s.end] for s in by[c].loss_spans]
        back = [x.replace("\\|", "\0").replace("\\\\", "\\").replace("\0", "|") for x in loss if "\\\\|" not in x]
        assert [x for x in back] == [x for r, x in want if r == "assistant" and "\\\\|" not in x.replace("\\", "\\\\").replace("<|", "<\\|")]
    assert [(t.role, t.text) for t in by[9].back] == [("", ""), ("", ""), ("assistant", "")]


def test_layouts(spark):
    two = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    cases = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages"),
        (2, {"turns": two}, "turns"),
        (3, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations"),
        (4, {"prompt": "hi", "completion": "yo"}, "prompt"),
        (5, {"instruction": "hi", "input": "", "output": "yo"}, "instruction"),
        (6, {"data": {"prompt": "hi", "response": "yo"}}, "nested"),
        (7, {"what": 1}, None),
        (11, {"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}]}, "parts"),
        # Further fields, at any depth.
        (12, {"id": 5, "meta": {"a b": [{"c": [1]}]}, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo"}]}, "messages"),
        (13, {"prompt": "hi", "response": "yo", "source": None}, "response"),
        # What isn't text where a layout has text is another layout.
        (14, {"messages": [{"role": "user", "content": {"other": "hi"}}]}, None),
        (15, {"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": {"other": "hi"}}]}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x, _ in cases] + [(8, None), (9, "not json"), (10, "[1]")], "conv_id int, record string")
    out = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert len(out) == 15 and len({out[i].fingerprint for i in (1, 11, 12, 14, 15)}) == 5
    for i, _, name in cases:
        assert out[i].layout == name
        if name:
            assert [(t.role, t.text) for t in out[i].turns] == [("user", "hi"), ("assistant", "yo")]
    assert all(out[i].formatted is None for i in (7, 8, 9, 10))
    assert C.format_chats(df.limit(0)).count() == 0


def test_op2_against_plain_python(spark):
    from quern.llm.queries import op2_chat_formatting

    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in op2_chat_formatting(spark, sf).collect()}
    convs = {-1: [(0, "user", CONTROL), (1, "assistant", CONTROL)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_rules_and_urls(spark):
    urls = [
        ("http://A.example.NET/en/1?x=/fr/", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://example.net", "example.net", "", None, None),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("x://www.example.com/de/1#y", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("h://" + "z9" * 20_000, "z9" * 20_000, "", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], 5, "x") for i, u in enumerate(urls)], "page_id int, url string, features int, host string")
    empty = U.fit(df.select("url", F.lit(1).alias("label")).limit(0))
    out = {r.page_id: r for r in U.filter_urls(df, URL_RULES, empty).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), i
        assert out[i].verdict == (verdict or "allow")


def test_trees_learn(spark):
    good = [f"http://site{i % 7}.example.com/a/{i}" for i in range(60)]
    bad = [f"http://x-{i % 5}-buy.example.com/p/{i}?a=1&b={i}&c=3" for i in range(60)]
    df = spark.createDataFrame([(u, int(u in bad)) for u in good + bad], "url string, label int")
    model = U.fit(df, iterations=4)
    seen = spark.createDataFrame([(1, "http://y-9-buy.example.com/p/8?a=1&b=2&c=3"), (2, "http://site9.example.com/a/7")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in U.filter_urls(seen, [], model).collect()} == {1: "block", 2: "allow"}
    assert model.pipeline and U.fit(df.where("label = 1")).constant == "block"


def test_rare_label_and_rare_hosts_count(spark):
    rows = [(f"http://h{i}.example.com/a/{i}", 0) for i in range(3000)] + [("http://x-buy.example.net/p?a=1&b=2", 1), ("http://x-buy.example.net/p?a=3&b=4", 1)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = U.fit(df, max_labelled=40, iterations=2)
    assert model.pipeline is not None and abs(model.prior - 2 / 3002) < 1e-12
    rates = {r.suffix3: r.suffix3_rate for r in model.rates["suffix3"].collect()}
    assert len(rates) == 3001 and max(rates, key=rates.get) == "x-buy.example.net"


def test_paths_of_any_depth(spark):
    deep = {"a": {"b.c": [{"d`e": [[{"f": 1}]], "g": {}}, {"h": None}]}, "t": "x:{\"y\"} \\", "l": [], "m": ["a", 1]}
    deeper = '{"k":' * 300 + "true" + "}" * 300
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, deeper), (3, '{"a":1,"a":2}'), (4, '{"a" : "x", "b":[1.5]}'), (5, "{}")], "i int, r string")
    out = {r.i: r.p for r in df.select("i", C.field_paths(C.schema_of(F.col("r"))).alias("p")).collect()}
    assert out[1] == sorted(["a.b.c[].d`e[][].f:BIGINT", "a.b.c[].g:OBJECT", "a.b.c[].h:VOID", "t:STRING", "l[]:VOID", "m[]:VARIANT"])
    assert out[2] == [".".join("k" * 300) + ":BOOLEAN"] and out[3] is None
    assert [p.split("(")[0] for p in out[4]] == ["a:STRING", "b[]:DECIMAL"] and out[5] == [":OBJECT"]


def test_texts_of_any_length_and_empty_lists(spark):
    long = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit('a<|"'), 5_300_000).alias("text"))
    pair = long.withColumn("conv_id", F.lit(2)).withColumn("role", F.lit("user")).unionByName(long.withColumns({"conv_id": F.lit(2), "turn": F.lit(1), "text": F.lit("ok")}))
    done = C.format_chats(C.records_of_turns(long.unionByName(pair))).select("conv_id", "layout", C.parse(F.col("formatted")).alias("back"))
    out = {r.conv_id: r for r in done.select("conv_id", "layout", F.size("back").alias("n"), F.length(F.col("back")[0]["text"]).alias("size"), F.xxhash64(F.col("back")[0]["text"]).alias("h")).collect()}
    want = long.select(F.xxhash64("text")).first()[0]
    assert all((out[i].size, out[i].h) == (21_200_000, want) for i in (1, 2)) and (out[1].layout, out[2].layout, out[2].n) == ("messages", "response", 2)
    none = spark.createDataFrame([(1, '{"messages": []}'), (2, '{"conversations": [], "system": "s"}')], "conv_id int, record string")
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.format_chats(none).collect()} == {1: [], 2: [("system", "s")]}


def test_layouts_of_rows_and_clashing_names(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "assistant", ""), (3, 0, "tool", "x"), (4, 0, "system", "s"), (4, 1, "gpt", "u"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, _rows string, record int")
    out = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in C.format_chats(C.records_of_turns(df)).collect()}
    assert out[1] == ("conversations", [("system", "s"), ("user", "u"), ("assistant", "a")]) and out[2] == ("response", [("user", "u"), ("assistant", "")])
    assert out[3] == ("messages", [("tool", "x")]) and out[4] == ("messages", [("system", "s"), ("gpt", "u")]) and out[None] == ("messages", [("", "")])
    assert C.records_of_turns(df.limit(0)).count() == 0


def test_held_out_hosts(spark):
    """Trees have to tell hosts they haven't seen; a host's own label is no feature while they are fitted."""
    rows = [(f"http://a{i % 40}.example.com/read/{i}", 0) for i in range(400)] + [(f"http://b-{i % 40}-x7{i % 9}.example.com/p?a={i}&b=2&c=3", 1) for i in range(400)]
    s = U.held_out_scores(spark.createDataFrame(rows, "url string, label int"), iterations=4).first()
    assert s.n > 50 and s.precision > 0.95 and s.recall > 0.95
    # Labels that only the host's name tells can't be learned from other hosts.
    rows = [(f"http://h{i % 60:02}.example.com/p/{i % 7}", int(i % 60 < 30)) for i in range(1200)]
    rates = U.rates_of_others(*[spark.createDataFrame(rows, "url string, label int").select("label", U.host_of(F.col("url")).alias("host")).withColumn("suffix3", F.col("host"))] * 2, "suffix3", 0.5)
    assert {r.suffix3_rate for r in rates.select("suffix3_rate").distinct().collect()} == {0.5}


def test_op5_on_the_tables(spark):
    from quern.llm.queries import labelled_urls, op5_url_filter

    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in op5_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, best and best.name)
        assert got[r.page_id].verdict == best.verdict if best else got[r.page_id].verdict in ("allow", "block")
    print("held-out hosts:", U.held_out_scores(labelled_urls(spark.read.parquet(f"{sf}/pages.parquet"))).first())


def test_urls_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.org/fr/x")], "page_id int, url string")
    empty = U.fit(df.select("url", F.lit(1).alias("label")).limit(0))
    assert sorted((r.page_id or 0, r.verdict) for r in U.filter_urls(df, URL_RULES, empty).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert U.filter_urls(df.limit(0), URL_RULES, empty).count() == 0
