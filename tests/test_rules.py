"""The rules' traps on hand-made rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from topicloom.functions import formula, text
from topicloom.functions.repair import repair
from topicloom.operators import aggregates as agg
from topicloom.operators import checks, merges
from topicloom.operators import placement as place
from topicloom.operators import windows as win
from topicloom.sources import catalog as src

TOPICS = "topic_id string, parent_topic_id string, domain_id string, title string, axis string, depth int, kind string, pos long"
STATEMENTS = "statement_id string, title string, latex string, plain string, layer_role string, content_kind string, source_node_id string, stage string, evidence int, confidence double, ord long"


def topics(spark, *rows):
    return spark.createDataFrame([(i, p, i.split(".")[0], t, "", i.count("."), "k", n) for n, (i, p, t) in enumerate(rows)], TOPICS)


def statements(spark, *rows):
    base = {"statement_id": None, "title": "", "latex": "x", "plain": "", "layer_role": None, "content_kind": None, "source_node_id": "A", "stage": "current", "evidence": 0, "confidence": None}
    return spark.createDataFrame([tuple((base | r | {"ord": n})[c.split()[0]] for c in STATEMENTS.split(", ")) for n, r in enumerate(rows)], STATEMENTS)


def test_casefold_and_white_space(spark):
    rows = [(None,), ("  Stra\u00dfe\x1c ΣΑΣ\u00a0 x ",), ("ﬁn",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalize_text(F.col("t"))).collect()]
    assert got == [re.sub(r"\s+", " ", t or "").strip().casefold() for (t,) in rows]


def test_casefold_of_all_letters(spark):
    """Each assigned code point, alone and between others, as Python's casefold has it."""
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = letters + ["Aß" + c + "ΟΔΟΣ ς" for c in letters if c.casefold() != c.lower()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", text.casefold(F.col("t")).alias("f")).collect()
    assert len(got) == len(texts) and [r["t"] for r in got if r["f"] != r["t"].casefold()] == []


def test_nearest_ancestor_climbs_the_id(spark):
    t = topics(spark, ("A", None, "a"), ("A.B", "A", "b"), ("A.B.C1", "A", "moved"))
    s = statements(spark, *[{"source_node_id": x} for x in ("A.B.C1.D.E", "A.B.C2", "A.BB", "Z", None, "A.B")])
    got = {r["ord"]: (r["topic_id"], r["mapping_method"]) for r in place.attach_nearest(s, t).collect()}
    near = "nearest_canonical_ancestor"
    assert got == {0: ("A.B.C1", near), 1: ("A.B", near), 2: ("A", near), 3: (None, None), 4: (None, None), 5: ("A.B", "exact_topic_id")}
    assert {(r["topic_id"], r["ancestor_id"]) for r in place.ancestors(t).collect()} == {("A", "A"), ("A.B", "A.B"), ("A.B", "A"), ("A.B.C1", "A.B.C1"), ("A.B.C1", "A")}


def test_first_and_best(spark):
    rows = [{"title": "One", "evidence": 1}, {"title": " one ", "evidence": 5}, {"title": "ONE", "evidence": 5}, {"statement_id": "i"}, {"statement_id": "i", "latex": "longer"}, {"latex": "y"}, {"latex": "y"}]
    s = statements(spark, *rows).withColumn("topic_id", F.lit("A")).withColumn("mapping_method", F.lit("exact_topic_id"))
    best = {r["ord"]: r["first_ord"] for r in win.dedupe_best(s).collect()}
    assert best == {1: 0, 4: 3, 5: 5, 6: 6}
    assert sorted(r["ord"] for r in win.dedupe_first(s).where("rn = 1").collect()) == [0, 3, 4, 5]


def test_quarantine_reasons_in_order(spark):
    build, reviewed, published = win.STAGES
    fallback = "missing_or_unresolved_specific_container"
    cases = [
        (build, "no_live_target", "no_live_target"), (build, "campaign_exact_sibling_title", "builder_only_not_independently_reviewed"), (published, "explicit_node_alias_ancestor", fallback), (published, "campaign_parent_fallback", fallback),
        (published, "campaign_single_affected_node", "affected_node_is_not_a_confirmed_primary_owner"), (published, "campaign_preferred_home", "placement_not_in_public_allowlist"), (reviewed, "campaign_preferred_home", None),
        (published, "explicit_node_alias", None), (reviewed, "campaign_existing_node", None),
    ]
    got = spark.createDataFrame(cases, "stage string, mapping_method string, want string").withColumn("got", merges.quarantine_reason())
    assert got.where("not (got <=> want)").count() == 0


def test_an_alias_to_nowhere_is_an_error(spark):
    s = statements(spark, {"source_node_id": "A.B", "title": "t"}).withColumn("topic_id", F.lit("A")).withColumn("mapping_method", F.lit("exact_topic_id"))
    aliases = spark.createDataFrame([("A.B", "Z")], "source_node_id string, target_node_id string")
    with pytest.raises(Exception, match="alias target"):
        merges.relocate_aliased(s, aliases, topics(spark, ("A", None, "a"))).collect()


def test_a_layer_must_be_what_it_declares(spark):
    s = statements(spark, {"source_node_id": "A", "title": "t"})
    t, now = topics(spark, ("A", None, "a")), s.limit(0).withColumn("topic_id", F.lit("A"))
    for status, mutated, n, why in (("PUBLISHED", False, 1, "status"), (merges.LAYER_STATUS[1], True, 1, "tree"), (merges.LAYER_STATUS[1], None, 1, "tree"), (merges.LAYER_STATUS[1], False, 2, "declares"), (None, False, 1, "status")):
        with pytest.raises(ValueError, match=why):
            merges.merge_layer(now, s, t, status, mutated, n)
    assert merges.merge_layer(now, s, t, merges.LAYER_STATUS[1], False, 1).first()["outcome"] == "added"


def test_relocated_rows_come_last_whatever_their_order(spark):
    s = statements(spark, {"source_node_id": "A.B", "title": "t", "latex": "moved"}, {"source_node_id": "A", "title": "t", "latex": "there"})
    s = s.withColumn("topic_id", F.col("source_node_id")).withColumn("mapping_method", F.lit("exact_topic_id")).withColumn("ord", F.when(F.col("latex") == "there", 5 * 10**12).otherwise(F.col("ord")))
    s = s.withColumn("latex", F.rpad("latex", 5, " "))
    got = merges.relocate_aliased(s, spark.createDataFrame([("A.B", "A")], "source_node_id string, target_node_id string"), topics(spark, ("A", None, "a"), ("A.B", "A", "b"))).collect()
    assert [(r["latex"], r["ord"], r["first_ord"]) for r in got] == [("there", 5 * 10**12, 5 * 10**12)]


def test_a_repeated_topic_id_stops_the_export(spark):
    t = topics(spark, ("A", None, "a"), ("A.B", "A", "b"))
    domains = spark.createDataFrame([("A", "Domain")], "domain_id string, display_name string")
    assert merges.rename_export(t, place.breadcrumbs(t), domains).count() == 3
    with pytest.raises(Exception, match="repeats"):
        merges.rename_export(t.union(t.where("depth = 1")), place.breadcrumbs(t), domains).collect()


def test_versions_and_compaction(spark, tmp_path):
    from topicloom.streaming import issues as log

    rows = [(1, "i", "submitted", "2026-01-01 00:00:00"), (2, "i", "edited", "2026-01-02 00:00:00"), (3, "i", "resolved", "2026-01-03 00:00:00"), (4, "j", "submitted", "2026-01-01 00:00:00"), (5, "i", "edited", "2025-12-31 00:00:00"), (6, "j", "resolved", "2026-02-01 00:00:00"), (7, "j", "edited", "2026-01-15 00:00:00")]
    events = spark.createDataFrame(rows, "event_id long, issue_id string, action string, at string").selectExpr("event_id", "issue_id", "action", "cast(at as timestamp) created_at")
    write = log.upsert_state(str(tmp_path), compact=3)
    for n in range(7):
        write(events.where(f"event_id = {n + 1}"), n)
    write(events.where("event_id = 7"), 6)  # delivered again
    got = sorted(map(tuple, log.read_state(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, log.state(events).select("issue_id", "status", "updated_at", "last_event_id", "n_events", "version", "opened_at").collect()))
    assert {r[0]: (r[1], r[5]) for r in got} == {"i": ("resolved", 3), "j": ("resolved", 2)}
    assert len(list(tmp_path.glob("upto=*"))) == 2


def test_delimiters_of_backslash_runs(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("\\\\\\($)[]x") for _ in range(rng.randrange(12))) for _ in range(400)]

    def odd(v, mark):
        return sum(1 for m in re.finditer(r"\\+", v) if len(m[0]) % 2 and v[m.end() : m.end() + 1] == mark)

    def dollars(v):
        inline = display = i = 0
        while i < len(v):
            if v[i] == "$" and v[i - 1 : i] != "\\":
                pair = v[i + 1 : i + 2] == "$"
                display, inline, i = display + pair, inline + (not pair), i + pair
            i += 1
        return inline, display

    d = formula.delimiters(F.col("v"))
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *[c.alias(n) for n, c in d.items()]).collect()
    for r in got:
        v = values[r["i"]]
        assert (r["open_inline"], r["close_inline"], r["open_display"], r["close_display"]) == tuple(odd(v, m) for m in "()[]"), v
        assert (r["inline_dollars"], r["display_dollars"]) == dollars(v), v


def test_repair():
    assert repair("a \\(x\n) b") == "a \\(x \\) b"
    assert repair("\\[ y ] and (z )") == "\\[ y \\] and (z )"
    assert repair("\x0crac{1}{2} \x01 e\u0301") == "\\rac{1}{2} \u00e9"
    assert repair("x \\\x08) \\\x08y") == "x \\) y"
    assert repair("a\u00a0\t  b\r\n  c") == "a b c"


def plain_repair(text):
    """The rules of repair(), a character at a time."""
    white = set("\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff") | {chr(c) for c in range(0x2000, 0x200B)}
    control = {chr(c) for c in (*range(9), 11, 12, *range(14, 32), 127)}
    text, out, i = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n"), "", 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] in {"\n", *control} and i + 1 < len(text):
            out += "\\" if text[i + 2 : i + 3] in (")", "]") and i + 2 < len(text) else ""
            i += 2
        else:
            out += text[i]
            i += 1
    text = "".join(("\\" if re.match("[A-Za-z]", out[i + 1 : i + 2]) else " ") if c in control else c for i, c in enumerate(out))
    text = "".join(" " if c in "\t\xa0\u202f\u205f\u3000" or "\u2000" <= c <= "\u200b" else c for c in text)
    text = "\n".join(line.strip(" ") if 0 < k < text.count("\n") else line.lstrip(" ") if k else line.rstrip(" ") if "\n" in text else line for k, line in enumerate(text.split("\n"))).replace("\n", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    text, out, depth = text.strip("".join(white)), "", {")": 0, "]": 0}
    i = 0
    while i < len(text):
        if text[i : i + 2] in ("\\(", "\\["):
            depth[")" if text[i + 1] == "(" else "]"] += 1
            out, i = out + text[i : i + 2], i + 2
        elif text[i : i + 2] in ("\\)", "\\]"):
            depth[text[i + 1]] = max(0, depth[text[i + 1]] - 1)
            out, i = out + text[i : i + 2], i + 2
        else:
            if text[i] in depth and depth[text[i]] and text[i - 1 : i] in white and i:
                depth[text[i]] -= 1
                out += "\\"
            out, i = out + text[i], i + 1
    return out


def test_repair_against_a_plain_scan(spark):
    rng = random.Random(12)
    pieces = ["\\", "\\(", "\\)", "\\[", "\\]", ")", "]", " ", "  ", "\n", "\r\n", "\r", "\t", "\x0c", "\x01", "\x1c", "\x7f", "\x85", "\ufeff", "\u00a0", "\u200b", "\u2028", "e\u0301", "a", "rac", "1", "$"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", "\x85a\x85", "\ufeffa\ufeff"]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", formula.formula_normalize("v").alias("out")).collect()
    for r in got:
        assert r["out"] == plain_repair(values[r["i"]]), repr(values[r["i"]])


def test_dollars_and_orphans(spark):
    rows = [("$a$ and $$b\nc$$ \\$d$e$",), ("\\(a\\) \\)  ",), ("\\(a \\)",), ("\\[a\\] \\]",), (formula.RESTRICTION[0],)]
    df = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in df.select(formula.dollars_to_tex(F.col("v"))).collect()][0] == "\\(a\\) and \\[b\nc\\] \\$d\\(e\\)"
    assert [r[0] for r in df.select(formula.trim_orphan(F.col("v"))).collect()][1:4] == ["\\(a\\)", "\\(a \\)", "\\[a\\]"]
    assert [r[0] for r in df.select(formula.dollars_to_tex(F.col("v"))).collect()][4] == formula.RESTRICTION[1]
    classes = spark.createDataFrame([("",), ("\\(",), ("a \\(x\\)",), ("words",), ("x_1 = 2",)], "v string").select(formula.latex_class(F.col("v"))).collect()
    assert [r[0] for r in classes] == ["empty", "source_error", "has_delimiters", "plain", "wrapped_inline"]


def test_hash_is_blind_to_order_and_the_edited_field(spark):
    t = topics(spark, *[(f"A.{i}", "A", f"t{i}") for i in range(50)])
    h = lambda df: agg.protected_hash(df, "title").first()[0]
    assert agg.protected_hash(t, "title", batch=4).first()[0] == agg.protected_hash(t.repartition(3), "title", batch=4).first()[0] != h(t)
    assert h(t) == h(t.orderBy(F.desc("pos")).repartition(5).withColumn("title", F.lit("other"))) != h(t.where("pos > 0"))


def test_shards_replace_whole_domains(spark, tmp_path):
    rows = spark.createDataFrame([("007", "c1", 1), ("007", "C.2", 2), ("d2", "c3", 3)], "domain_id string, chapter_id string, x int")
    path, schema = str(tmp_path / "shards"), "chapter_id string, x int"
    there = lambda: sorted((r["domain_id"], r["chapter_slug"], r["x"]) for r in src.read_chapter_shards(spark, path, schema).collect())
    assert there() == []
    src.write_chapter_shards(rows, path)
    assert there() == [("007", "c-2", 2), ("007", "c1", 1), ("d2", "c3", 3)]
    src.write_chapter_shards(rows.where("chapter_id = 'c1'"), path)
    assert there() == [("007", "c1", 1), ("d2", "c3", 3)]
    again = src.read_chapter_shards(spark, path, schema).drop("chapter_slug")
    counts = src.write_chapter_shards(again, path)  # rows that are read from the path itself
    assert sorted((r["domain_id"], r["chapter_slug"], r["topics"]) for r in counts.collect()) == [("007", "c1", 1), ("d2", "c3", 1)]
    many = spark.range(1000).selectExpr("'d2' domain_id", "'c3' chapter_id", "cast(id as int) x")
    src.write_chapter_shards(many, path, file_rows=100)
    src.remove_old_shards(spark, path)
    assert len(there()) == 1001 and len(list(tmp_path.glob("shards/version-*"))) == 2 and len(list(tmp_path.glob("shards/pointer-*"))) == 1
    files = [len(f.read_text().splitlines()) for f in tmp_path.glob("shards/version-*/domain_id=d2/chapter_slug=c3/*.json")]
    assert sum(files) == 1000 and max(files) <= 100
    with pytest.raises(ValueError, match="shards already"):
        src.write_chapter_shards(rows.withColumn("lazy_content", F.lit(True)), path)


def test_a_writer_that_stops_leaves_the_old_shards(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path), "chapter_id string, x int"
    rows = lambda x: spark.createDataFrame([("d", "c", x)], "domain_id string, chapter_id string, x int")
    there = lambda: [r["x"] for r in src.read_chapter_shards(spark, path, schema).collect()]
    src.write_chapter_shards(rows(1), path)

    def stop(*_):
        raise OSError("stopped")

    with pytest.raises(Exception, match="stopped"):  # while it writes its rows
        src.write_chapter_shards(rows(2).withColumn("x", F.raise_error(F.lit("stopped")).cast("int")), path)
    assert there() == [1]
    with monkeypatch.context() as m, pytest.raises(OSError):  # before its pointer
        m.setattr(src, "_publish", stop)
        src.write_chapter_shards(rows(2), path)
    assert there() == [1]
    (tmp_path / "_half").write_text('{"d": "nowhere')  # a pointer that hasn't its name yet
    assert there() == [1]
    with pytest.raises(RuntimeError, match="another writer"):
        src._publish(spark, path, 1, {})
    src.write_chapter_shards(rows(3), path)
    assert there() == [3]


def test_rows_are_taken_in_order_under_two_keys(spark):
    """Chains, hot keys and random clashes, in rounds and in the loop, against a plain loop."""
    rng = random.Random(9)
    tables = [[(i, f"t{rng.randrange(40)}", f"i{rng.randrange(60)}") for i in range(400)], [(i, f"t{i // 2}", f"i{(i + 1) // 2}") for i in range(40)], [(i, "t", f"i{i}") for i in range(100)], []]
    for rows in tables:
        want, held = [], (set(), set())
        for o, a, b in rows:
            if a not in held[0] and b not in held[1]:
                want.append(o)
                held[0].add(a)
                held[1].add(b)
        d = spark.createDataFrame(rows, "ord long, a string, b string").repartition(3)
        for loop_rows in (0, 7, 1000):
            assert sorted(r["ord"] for r in merges.accepted(d, "a", "b", loop_rows=loop_rows).collect()) == want


def test_layer_outcomes_against_a_loop(spark):
    """Clashing titles and ids over topics; records without a title or an id."""
    rng = random.Random(10)
    t = topics(spark, ("A", None, "a"), ("A.B", "A", "b"), ("A.C", "A", "c"))
    now = statements(spark, {"statement_id": "s0", "title": "One"}, {"statement_id": "s1", "title": ""}).withColumn("topic_id", F.lit("A.B"))
    raw = [{"source_node_id": rng.choice(["A.B", "A.B.X", "A.C", "Z"]), "title": rng.choice(["one", "Two ", "two", "", "Three"]), "statement_id": rng.choice([None, *(f"s{i}" for i in range(12))])} for _ in range(120)]
    titles, ids, want = {("A.B", "one")}, {"s0", "s1"}, []
    for r in raw:
        topic, key = {"A.B.X": "A.B", "Z": None}.get(r["source_node_id"], r["source_node_id"]), r["title"].strip().lower()
        o = "unmapped" if topic is None else "duplicate_title" if key and (topic, key) in titles else "duplicate_id" if r["statement_id"] in ids else "added"
        if o == "added":
            titles |= {(topic, key)} if key else set()
            ids |= {r["statement_id"]} - {None}
        want.append(o)
    for loop_rows in (0, 5, 1000):
        got = merges.merge_layer(now, statements(spark, *raw), t, merges.LAYER_STATUS[0], False, len(raw), loop_rows)
        assert [r["outcome"] for r in got.orderBy("ord").collect()] == want


def test_numbers_within_groups_of_any_size(spark):
    rows = [(f"k{i % 3 if i % 2 else 0}", i % 50, i) for i in range(900)]
    got = win.numbered(spark.createDataFrame(rows, "k string, a long, b long").repartition(5), ["k"], ["a", "b"]).collect()
    for k in {r["k"] for r in got}:
        mine = sorted((r["a"], r["b"], r["number"]) for r in got if r["k"] == k)
        assert [n for *_, n in mine] == list(range(1, len(mine) + 1))


def test_one_node_of_a_third_of_all_rows(spark):
    t = topics(spark, ("A", None, "a"), ("A.B", "A", "b"))
    s = spark.range(3000).selectExpr("case when id % 3 = 0 then 'A.B.hot' else concat('A.', id % 7, '.', id) end source_node_id", "id ord")
    out = place.attach_nearest(s, t)
    assert {(r["topic_id"], r["count"]) for r in out.groupBy("topic_id").count().collect()} == {("A.B", 1000), ("A", 2000)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Window" not in plan


def test_aliases_to_nowhere_and_titles_of_the_first_snapshot(spark):
    rows = [("x", None, "A", None, 1), ("x", "gone", "A", None, 0)]
    m = spark.createDataFrame(rows, "source_node_id string, primary_target_node_id string, target_node_id string, target_node_ids array<string>, ord long")
    t = topics(spark, ("A", None, "a"))
    assert place.alias_map(m).first()["target_node_id"] == "A" == place.alias_map(m.where("ord = 1"), t).first()["target_node_id"]
    with pytest.raises(Exception, match="outside the tree"):
        place.alias_map(m, t).collect()


def test_trees_and_broken_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text('{"domain_id": "d", "roots": [{"topic_id": "A", "title": "a", "children": [{"topic_id": "A.1", "children": []}, {"topic_id": "A.2", "children": [{"topic_id": "A.2.1"}]}]}]}')
    (tmp_path / "two.json").write_text("{broken")
    docs = src.read_json(spark, str(tmp_path), src.CATALOG)
    assert docs.where("domain_id is null").count() == 1
    rows = src.flatten_tree(docs).orderBy("path").collect()
    assert [(r["topic_id"], r["parent_topic_id"], r["depth"]) for r in rows] == [("A", None, 0), ("A.1", "A", 1), ("A.2", "A", 1), ("A.2.1", "A.2", 2)]
    stubs = spark.createDataFrame([("d", "A", "u", "stub"), ("d", "B", "v", "stub")], "domain_id string, topic_id string, shard_url string, raw string")
    wrong = spark.createDataFrame([("u", "C", "root")], "shard_url string, chapter_id string, root string")
    with pytest.raises(Exception, match="another chapter"):
        src.restore_domain(stubs, wrong).collect()


def test_report_passes_only_without_failures(spark):
    t = topics(spark, ("A", None, "a"), ("A.B", "A", "b"))
    assert checks.report(checks.structure(t)).first()["status"] == "PASS"
    assert checks.report(checks.structure(t.union(t.where("depth = 1")))).first()["failing_codes"] == "duplicate_topic_id"
