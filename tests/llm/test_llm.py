"""The operators on text and names against brute force, with nulls, ties, repeats, skew and empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plausia.llm import components, leakage, ledger, mixing, names, residue


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "x"), (None, "y"), ("c3", "c4")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((x, root(x)) for x in parent)
    assert got(components.connected_components(spark.createDataFrame(edges, "u string, v string"))) == want
    assert got(components.connected_components(spark.createDataFrame([], "u string, v string"))) == []


SAME = [
    ["Greta Brumogene", "Brumogene, Greta", "Gre. Brumogene", "Grea Brumogene", "GRETA BRUMOGENE", "greta_brumogene", "G. Brumogene", "Dr. Greta Brumogene", "Greta L. Brumogene", "Grétä Brumogene"],
    ["William Fozihugi", "Bill Fmzihugi", "Fozihugi, W."], ["Mabritrohe Press Inc", "Mabritrohe Pres.", "The Mabritrohe Press", "MABRITROHE PRESS INCORPORATED", "press-mabritrohe"],
    ["Branobrogi", "Bran Obrogi", "Project Branobrogi", "Branobrgoi"], ["Thomas Zibrofuzi", "Tom Zibrofuzi"],
]
APART = ["Greta Bulazigu", "Chiara Brumogene", "Tomas Mafukidre", "Nimiwidri Foods", "Nimiwidri Analytics GmbH", "Walter Drakukepo", "William Drakukepo", "alumni"]


@pytest.mark.parametrize("max_block", [200, 2, 1])
def test_name_variants(spark, max_block):
    rows = [(n,) for group in SAME for n in group] + [(n,) for n in APART] + [("W. Drakukepo",), (None,), ("",), (" ",), ("--",), ("Greta Brumogene",), ("z" * 2_000,), (" ".join(f"word{i}" for i in range(60)),)]
    pairs = got(names.variant_pairs(spark.createDataFrame(rows, "name string"), max_block))
    assert set(pairs) == {(a, b) for g in SAME for a in g for b in g if a < b}
    assert got(names.variant_pairs(spark.createDataFrame([], "name string"))) == []


@pytest.mark.parametrize("max_block", [200, 2, 1])
def test_crowded_blocks_find_the_same(spark, max_block):
    """A nickname beside a slip that changes the Soundex, short forms of two kinds, two slips in one token and in two, six words with a
    slip that moves a token, and three words typed as two."""
    same = [
        ["Bob Smirh", "Robert Smith"], ["Bob Zora Vulkim", "Robert Vulnim Zora"], ["Robe. Frank", "Robert Frank"], ["B. Fozihugi", "Bill Fozihugi"], ["Kat. Nerejeke", "Kate Nerejeke"], ["Christophr Jolubeno", "Cristopher Jolubeno"],
        ["Quenitn Netemiri", "Quentin Neteoiri"], ["Markus Munster Zedler Carla Doran Petuva", "Narkus Munster Zedler Carla Doran Petuva"], ["Lake View Halden", "Lakeview Halden"],
    ]
    fill = [f"Robert {x}" for x in ("Sawoch", "Sipakuth", "Sogedah", "Sufibeh")] + [f"Robert Zora {x}" for x in ("Vasetum", "Vopigam", "Vebodom")] + [f"{x} Frank" for x in ("Rolugadi", "Rimesabo", "Rukotefi")]
    df = spark.createDataFrame([(n,) for n in [n for g in same for n in g] + fill], "name string")
    assert set(got(names.variant_pairs(df, max_block))) == {(a, b) for g in same for a in g for b in g if a < b}


def test_long_names():
    words = [f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(1000)]
    tokens = lambda ws: sorted((w, False) for w in ws)
    slipped, other, bob, robert = [*words[:-1], "wodrjjj"], [*words[:-2], "wordxyz", "wordzyx"], ["bob", *words[:20]], ["robert", *words[:20]]
    for x, y, kind in ((words, slipped, "slip"), (words, other, None), (bob, robert, "short"), (words, words[::-1], "same"), (["z" * 20_000], ["z" * 20_001], None)):
        a, b = tokens(x), tokens(y)
        assert names.compare(a, b) == kind
        if kind:
            assert names.block_keys(a) & names.block_keys(b) and names.finer_keys(a) & names.finer_keys(b)
    assert len(names.finer_keys([("z" * 20_000, False)])) < 10 and len(names.block_keys(tokens(["bob"] * 1000))) < 3000


def test_finer_keys_meet_whatever_is_accepted():
    rng = random.Random(11)
    first, nicks = ["robert", "bob", "rob", "william", "bill", "eleanor", "nell", "thomas", "gregory", "r", "w", "tho.", "gre."], "netemiri kogijozzo brumogene ladrulasi smith lee fozihugi".split()

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeknt") + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w])

    cores = {tuple(sorted((t.rstrip("."), t.endswith(".")) for t in (rng.choice(first), slip(slip(rng.choice(nicks))), *(["zora"] if rng.random() < 0.3 else [])) if t)) for _ in range(300)}
    cores, accepted = sorted(cores), 0
    for i, a in enumerate(cores):
        for b in cores[:i]:
            kind = names.compare(list(a), list(b))
            assert kind == names.compare(list(b), list(a))
            if kind:
                accepted += 1
                shared = names.finer_keys(list(a)) & names.finer_keys(list(b))
                form = lambda c: max(names.token_form(*t) for t in c)
                assert any(not only_short or form(a) != form(b) for _, only_short in shared), (a, b, kind)
    assert accepted > 100


def test_jaro_winkler_and_slips():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.one_slip("abcd", "abdc") and names.one_slip("abcd", "abd") and names.one_slip("abd", "abcd") and names.one_slip("abcd", "abxd")
    assert not names.one_slip("abcd", "abcd") and not names.one_slip("abcd", "axyd") and not names.one_slip("ab", "abcd")
    assert names.two_slips("abcd", "axyd") and names.two_slips("abcd", "bacde") and not names.two_slips("abcd", "wxyd")
    assert names.soundex("robert") == names.soundex("rupert") == "R163" and names.soundex("tymczak") == "T522"
    assert names.compare(names.read("Chiara Brumogene"), names.read("Greta Brumogene")) is None and names.compare(names.read("Walter Drakukepo"), names.read("Walter Drakuzipo")) is None


def test_typed_names(spark):
    edges = spark.createDataFrame([("A", None)], "source_entity string, target_entity string")
    dims = spark.createDataFrame([("X.y.attr",), (None,), ("nodot",)], "id string")
    assert sorted(r.name or "" for r in names.typed_names(edges, dims).collect()) == ["", "A", "X.y"]


EVENTS = "id string, text string, source string, speaker string, key string, n int"


def brute_key(text, speaker):
    letters = lambda s: re.sub(r"[\W_]", "", s.lower())
    fields = lambda s: [f for f in re.split(r"[;|\r\n]+", s) if f.strip()]
    form = re.compile(r"[^:=]*[^\W_][^:=]*[:=].*[^\W_].*", re.S)
    kv = lambda s: len(fields(s)) >= 2 and all(form.fullmatch(f) for f in fields(s))
    who = letters(speaker) if speaker and letters(speaker) else None
    if ":" in text:
        name, rest = text.split(":", 1)
        loses = kv(text) and not (fields(rest) and form.fullmatch(fields(rest)[0]))
        if (len(name) <= 60 and letters(name) and not loses) if who is None else letters(name) == who:
            who, text = who or letters(name), rest
    return who, "".join(sorted(map(letters, fields(text)))) if kv(text) else letters(text)


def test_formatting_duplicates(spark):
    base = [
        ("Hello, world 42!", "Ann"), ("HELLO   world 42", "ann "), ("Ann: hello world 42", None), ("Ann: hello world 42", "Ann"), ("Bob: hello world 42", "Ann"), ("hello world 42", None), ("hello world 43", "Ann"),
        ("city: Rome; team: red", "Ann"), ("TEAM=RED | City : Rome", "Ann"), ("Ann: team: red\ncity: rome;", None), ("city: Rome; team: red", None), ("team: red; city: Rome", None), ("city: Rome", "Ann"), ("city Rome team red", "Ann"),
        ("", "Ann"), ("!!!", "Ann"), (None, "Ann"), ("x" * 61 + ": hi", None), ("x" * 60 + ": hi", None), ("é" * 3000, None), ("É" * 3000, " "), ("", None),
    ]
    rows = [(f"id{i:02}", t, "import" if i % 2 else "chat", s, "k", i) for i, (t, s) in enumerate(base)] + [(None, "Hello, world 42!", "chat", "Ann", "k", 1)]
    events = spark.createDataFrame(rows, EVENTS)
    groups = {}
    for i, t, _, s, *_ in rows:
        if i is not None and t is not None:
            groups.setdefault(brute_key(t, s), []).append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    for batches in ([events], [events.where("source = 'chat'"), events.where("source = 'import'")], [events.limit(0), events]):
        assert got(ledger.copies(batches)) == want
        assert got(ledger.ledger_of(batches)) == sorted((min(g), len(g)) for g in groups.values())
    assert got(ledger.copies([events.limit(0)])) == []


def test_a_group_with_most_rows_and_later_batches(spark):
    a = spark.range(600).select(F.format_string("b%04d", "id").alias("id"), F.lit("Same, text").alias("text"), F.lit(None).cast("string").alias("speaker"))
    b = spark.range(5).select(F.format_string("a%04d", "id").alias("id"), F.lit("same TEXT").alias("text"), F.lit(None).cast("string").alias("speaker"))
    assert got(ledger.ledger_of([a, b])) == [("a0000", 605)]


def test_a_ledger_rewrites_only_touched_buckets(spark):
    turns = lambda rows: ledger.count_batch(ledger.keyed(spark.createDataFrame([(i, t, None) for i, t in rows], "id string, text string, speaker string")))
    book = ledger.Ledger(spark)
    assert book.buckets().count() == 0
    book.add(turns([(f"k{i:03}", f"text {i}") for i in range(100)]))
    before = dict(book.current())
    book.add(turns([("a", "TEXT, 7"), ("z", "text 7"), ("new", "other")]))
    after = dict(book.current())
    assert 1 <= sum(before.get(b) != v for b, v in after.items()) <= 2
    rows = {r.keep_id: r.n for r in book.buckets().collect()}
    assert rows == {f"k{i:03}": 1 for i in range(100) if i != 7} | {"a": 3, "new": 1}
    book.compact()
    assert {r.keep_id: r.n for r in book.buckets().collect()} == rows and len(book.lists()) == 1
    book.add(turns([]))
    assert book.buckets().count() == 101
    book.drop()


WORDS = [f"w{i}" for i in range(400)]


def brute_leaks(docs, items, n=13):
    held = {}
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in held.get(tuple(w[k : k + n]), ())}
    return sorted(out, key=repr)


@pytest.mark.parametrize("shipped", [10_000, 3])
def test_leaks(spark, monkeypatch, shipped):
    monkeypatch.setattr(leakage, "MOST_SHIPPED", shipped)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(3, 40)))) for i in range(30)] + [(30, None), (31, ""), (None, "a b"), (5, "w1 w2 w3")]
    items += [(32, "common start of every single question here then " + " ".join(WORDS[:20])), (33, "common start of every single question here then " + " ".join(WORDS[20:40]))]
    docs = []
    for d in range(80):
        filler = [" ".join(rng.choices(WORDS, k=30)) for _ in range(2)]
        item = rng.choice([t for _, t in items if t and len(t.split()) > 14]).split()
        n = rng.choice([11, 12, 13, 14, len(item)])
        at = rng.randrange(max(1, len(item) - n + 1))
        cut = item[at : at + n]
        docs.append((d, filler[0] + ". " + rng.choice([" ", "_", ", \n"]).join(w.upper() if rng.random() < 0.3 else w for w in cut) + " " + filler[1]))
    docs += [(90, None), (91, ""), (92, "!!"), (93, " ".join(rng.choices(WORDS, k=20_000)) + " " + items[0][1] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)).withColumn("words", F.lit("x"))
    runs = leakage.leaked_runs(df, spark.createDataFrame(items, "item_id long, text string"))
    found = got(runs.select("doc_id", "item_id"))
    assert all(r.longest_run >= 13 and r.score > 0 for r in runs.collect())
    assert found == brute_leaks([x for x in docs], [x for x in items if x[0] is not None])


def test_edited_copies_score(spark):
    item = " ".join(WORDS[:40])
    edited = " ".join(w for i, w in enumerate(WORDS[:40]) if i % 9 != 8)
    docs = spark.createDataFrame([(1, edited), (2, " ".join(WORDS[100:150])), (3, item)], "doc_id long, text string")
    out = {r.doc_id: r for r in leakage.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3} and out[3].score == 1.0 and out[3].longest_run == 40 and 0.8 < out[1].score < 1 and out[1].longest_run == 8
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(leakage.leaks(docs, none)) == [] and got(leakage.leaks(docs.limit(0), none)) == []


def brute_score(item, doc):
    best, row = 0, [0] * (len(doc) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(doc):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(item))


@pytest.mark.parametrize("shipped", [10_000, 200])
def test_edited_copies_of_common_items(spark, monkeypatch, shipped):
    """Items in more documents than rare n-grams may be in, beside copies that lack some of their n-grams, or all."""
    monkeypatch.setattr(leakage, "MOST_SHIPPED", shipped)
    rng = random.Random(8)
    items = [WORDS[:40], WORDS[30:60], WORDS[100:106], rng.choices(WORDS[:12], k=44)]
    fill = lambda n: rng.choices(WORDS[200:], k=n)
    texts = [fill(6) + item + fill(6) for item in items for _ in range(55)]
    for item in items:
        texts += [fill(3) + [w for i, w in enumerate(item) if i % k != k - 1] + fill(3) for k in (2, 3, 4, 5, 9)]
        texts += [fill(300) + [fill(1)[0] if i % k == k - 1 else w for i, w in enumerate(item)] + fill(90) for k in (3, 4, 5, 9)]
        texts += [[x for w in item for x in (w, *fill(n))] for n in (1, 2)] + [item[:20] + fill(n) + item[20:] for n in (9, 15, 30)]
        texts += [item[: len(item) // 2], sorted(item), rng.sample(item, len(item))]
    texts += [rng.choices(WORDS[:12], k=60) for _ in range(10)] + [[]]
    want = {(d, i): round(brute_score(item, doc), 6) for d, doc in enumerate(texts) for i, item in enumerate(items)}
    want = {k: s for k, s in want.items() if s >= 0.6}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    out = leakage.leaks(docs, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 6) for r in out if r.score >= 0.6} == want
    assert all(r.score == pytest.approx(brute_score(items[r.item_id], texts[r.doc_id])) for r in out)


TARGETS = "source string, weight double, max_repeats int"


def test_mixture(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 60))), ["a"] * 6 + ["b"] * 2 + ["c", None], "x") for i in range(700)]
    docs = [(i, t, s[i % 10], x) for i, t, s, x in docs] + [(800, None, "a", "x"), (801, "", "b", "x"), (None, "lost", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("none", 0.05, 2), (None, 0.1, 1)], TARGETS)
    mixed = mixing.mix(df, targets, group_rows=40)
    rows = mixed.toPandas()
    assert len(rows) == 630 + 2 and not rows.doc_id.duplicated().any()
    caps = {"a": 1, "b": 3, "c": 4}
    assert all(r.copies <= caps[r.source] for r in rows.itertuples())
    assert (rows.groupby("source").copies.agg(lambda c: c[rows.n_tokens > 0].max() - c[rows.n_tokens > 0].min()) <= 1).all()
    tokens = (rows.copies * rows.n_tokens).groupby(rows.source).sum()
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert tokens[s] / tokens.sum() == pytest.approx(w / 0.95, abs=0.01)
    assert got(mixing.mix(df.repartition(7), targets, group_rows=40)) == got(mixed)
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert report["none"].mixed_tokens == 0 and set(report) == {"a", "b", "c", "none"}
    assert [s for s, r in report.items() if r.binding] == ["a"] and report["a"].total_tokens == tokens.sum() and report["none"].tokens == 0
    fixed = mixing.mix(df, targets, total_tokens=1000)
    assert (fixed.toPandas().eval("copies * n_tokens").sum()) == pytest.approx(950, abs=120)
    assert got(mixing.mix(df.limit(0), targets)) == [] and got(mixing.mix(df, targets.limit(0))) == []


def test_both_vocabulary_files_count_alike(spark):
    texts = [(1, "It's  a test, naïve 123 x" * 9, "a"), (2, "<|endoftext|>\n\n  end ", "a"), (3, None, "a"), (4, "字" * 5000, "b")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert got(mixing.token_sizes(df)) == got(mixing.token_sizes(df, "/opt/tokenizers/byte_bpe_50k.json"))


def test_pivot_keeps_the_tokens():
    rng = random.Random(0)
    for _ in range(200):
        p, size = [rng.random() for _ in range(30)], [rng.randrange(0, 50) for _ in range(30)]
        out, held = mixing.pivot(p, size, rng)
        assert sum(x * s for x, s in zip(out, size)) == pytest.approx(sum(x * s for x, s in zip(p, size)), abs=1e-6)
        assert all(x in (0, 1) for i, x in enumerate(out) if i != held)
    drawn = [sum(mixing.pivot([0.3] * 10, [5] * 10, random.Random(s))[0]) for s in range(50)]
    assert set(map(round, drawn)) == {3}


CONTENT = ["The memory keeps the old value with less weight.", "Ann works for the press.", "Our review found that the budget was stored twice.", "La mémoire garde l'ancienne valeur.", "He said the evening starts at 5 and costs 32 crowns."]
BAD = [
    "404 Not Found", "Dear {{first_name}}, welcome to %%CITY%%.", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Internal server error (reference 3d7509).",
    "Cette page n'existe plus.", "Esta página ha caducado.", "Replace this paragraph with your own words.", "[insert company here] moved to ________.", "Access denied.", "<html><body><h1>502 Bad Gateway</h1></body></html>",
]
TALK = [
    "The prompt file holds {{user_name}} and the loader fills it before every call, Ann explained.", "We banned lorem ipsum from the decks because Ann took it for a quotation.", "Ann joked that access denied is the only message they send.",
    "Ann fragte, warum die Fehlerseite 404 im Speicher gelandet war.", "* Ann.start_date = tbd (confidence 0.90)", "The ticket [PROJ-72] is done. [P=0.651, surprise 3.01]",
]


def test_residue(spark):
    """Slots, errors, notices and fillers among contents; reports of such things beside them stay out."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(CONTENT, k=5)), None) for i in range(200)]
    docs += [(300 + i, b, "x") for i, b in enumerate(BAD * 3)] + [(400 + i, rng.choice(CONTENT) + " " + b + "\n" + rng.choice(CONTENT), "x") for i, b in enumerate(BAD * 3)]
    docs += [(500 + i, rng.choice(CONTENT) + "\n" + t, "x") for i, t in enumerate(TALK * 5)] + [(600, None, "x"), (601, "", "x"), (602, CONTENT[0] * 2000, "x"), (603, "\x00 <b \x00", "x"), (None, BAD[0], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, passage string")
    assert [r[0] for r in got(residue.residue_records(df).select("doc_id"))] == [*range(300, 300 + 3 * len(BAD)), *range(400, 400 + 3 * len(BAD))]
    assert got(residue.residue_records(df.limit(0))) == []
    assert got(residue.residue_records(df.where("doc_id < 200"))) == []


def test_residue_is_learned_from_company(spark):
    """A wording that isn't trusted is learned from words that it shares with trusted passages, and one slot alone
    from the sentence around it."""
    docs = [(i, CONTENT[i % 5]) for i in range(100)] + [(200 + i, "Access denied.") for i in range(20)] + [(300 + i, "Denied.") for i in range(4)]
    rng = random.Random(3)
    value = lambda n: rng.choice("Rome Oslo Bern Riga Kyiv Lyon Graz Turin Porto Delft".split()) + n
    fill = lambda i: "{} moved to {} with the {} people last week.".format(*(f"{{{{{n}}}}}" if i >> k & 1 else value(n) for k, n in enumerate(("name", "city", "firm"))))
    docs += [(400 + i, fill(i % 8)) for i in range(80)]
    found = {r.doc_id: r.n_trusted for r in residue.residue_records(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {*range(200, 220), *range(300, 304)} <= set(found) <= {*range(200, 220), *range(300, 304), *(400 + i for i in range(80) if i % 8)}
    assert found[300] == 0 and any(found.get(400 + i) == 0 for i in range(80) if i % 8 in (1, 2, 4))


def passages(text):
    no, trusted, slotted, sizes, flat = residue.read([text], residue.Vocabulary())
    return list(zip(trusted.tolist(), slotted.tolist(), sizes.tolist()))


@pytest.mark.parametrize("text", ["404", "(HTTP 503)", "Error 502.", "Lorem ipsum dolor sit amet " + "velit " * 40, "Access denied.", "asdf asdf asdf", "{{a}} wrote to {{b}} on Monday about the long list of things that were open", "Blindtext.", "Bitte aktivieren Sie JavaScript.", "<h1>404</h1>"])
def test_trusted_passages(text):
    assert [t for t, *_ in passages(text)] == [True]


@pytest.mark.parametrize("text", ["404 apples were sold on the market.", "0 0 0 0", "1 2 3", "The prompt file holds {{user_name}} and the loader fills it.", "We banned lorem ipsum from the demo decks because Ann took it for a quotation.", "[P=0.9, surprise 3.0]", ""])
def test_untrusted_passages(text):
    assert not any(t for t, *_ in passages(text))


def test_texts_read_together_read_alike():
    texts = [*BAD, *TALK, *CONTENT, "", "<b open", "{{ open", "\x00", "a\r\n\nb. c! d", "X" * 50, "é" * 9, "_" * 9, "x " * 3000]
    no, trusted, slotted, sizes, flat = residue.read(texts, residue.Vocabulary())
    ends = sizes.cumsum()
    for i, t in enumerate(texts):
        one = residue.read([t], residue.Vocabulary())
        mine = no == i
        assert trusted[mine].tolist() == one[1].tolist() and slotted[mine].tolist() == one[2].tolist() and sizes[mine].tolist() == one[3].tolist()
        assert [x for e, n in zip(ends[mine], sizes[mine]) for x in flat[e - n : e].tolist()] == one[4].tolist()


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_residue_held_out(spark, scale):
    """Half of the trusted records lose their mark; the model must find them again."""
    from pathlib import Path

    path = Path(f"/root/testdata/{scale}/documents.parquet")
    if not path.exists():
        pytest.skip("needs the supplied tables")
    rows = residue.passage_rows(spark.read.parquet(str(path)))
    held = rows.withColumn("trusted", F.when(F.col("doc_id") % 2 == 0, F.col("trusted")).otherwise(F.transform("trusted", lambda _: F.lit(False))))
    scores = rows.mapInArrow(residue._scores(residue.fit(held), 0.95), residue._SCORES).where("doc_id % 2 = 1").collect()
    withheld = {r.doc_id for r in scores if r.n_trusted}
    assert withheld and len({r.doc_id for r in scores if r.n_residue} & withheld) >= 0.9 * len(withheld)


def test_nothing_else_imports_this_package():
    from pathlib import Path

    root = Path(residue.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in re.findall(r"^\s*(?:from|import)\s+([\w.]+)", path.read_text(), re.M).__repr__()
