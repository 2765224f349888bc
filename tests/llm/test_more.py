"""Quality rules, personal data and secrets against plain versions and planted cases."""

import collections
import re

from scholarspark.llm import pii, quality, secrets

from .test_docs import SCHEMA, corpus


def brute_quality(rows, min_docs=20, max_share=0.1, max_lost=0.5, max_docs=1000, copies=True):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    norm = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x.lower()).strip(" ")
    holders, texts = collections.defaultdict(set), collections.defaultdict(set)
    for i, (_, t, s) in enumerate(rows):
        one = i if copies else t or ""
        texts[s].add(one)
        for x in (t or "").split("\n"):
            holders[s, norm(x)].add(one)
    out = {}
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        often = lambda x: len(holders[s, norm(x)]) > min_docs and (len(holders[s, norm(x)]) > max_share * len(texts[s]) or len(holders[s, norm(x)]) > max_docs)  # noqa: B023, E731
        lost = sum(len(norm(x).split(" ")) for x in lines if often(x))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out[d] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed and lost <= max_lost * len(words))
    return out


def test_quality(spark):
    rows = [(d, t, s) for d, t, _, s, *_ in corpus()]
    boiler = "All rights are reserved by the Owner of these pages and by nobody else at all in any land."
    rows += [(3000 + i, "\n".join([boiler.upper() if i % 2 else "  " + boiler, " ".join(f"w{i}x{j}" for j in range(60 if i % 3 else 4)), boiler, boiler]), "host") for i in range(40)]
    rows += [(4000, "a b c " * 40, "s1"), (4001, " ".join(f"u{j}" for j in range(60)) + " # * <", "s1"), (4002, "x y\nx y\n \nx y", "s1")]
    table = spark.createDataFrame([(d, t, "en", s, 1, "u", 2, "h", 3, 4, "f") for d, t, s in rows], SCHEMA).repartition(3)
    for limits in ({}, {"min_docs": 2, "max_share": 0.02, "max_lost": 0.3}, {"min_docs": 2, "max_share": 0.02, "copies": False}):
        want = [(d, *brute_quality(rows, **limits)[d]) for d, _, _ in rows if d not in (None, 5)]
        got = quality.quality_rules(table, **limits).collect()
        assert len(got) == len(rows)
        assert sorted(tuple(r)[:8] for r in got if r.doc_id not in (None, 5)) == sorted(want)
        kept = quality.keep_good(table, **limits)
        assert kept.columns == table.columns
        ids = collections.Counter(r.doc_id for r in kept.collect())
        assert ids == collections.Counter(r.doc_id for r in got if r.kept)
    assert any(not w[-1] and not w[-2] for w in want) and any(w[-1] for w in want)
    none = spark.createDataFrame([], SCHEMA)
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_in_large_host(spark):
    """A line in over 1,000 documents is boilerplate however large its host is; documents of little else pass the base rules and are rejected."""
    boiler = " ".join(f"b{j}" for j in range(100))
    rows = [(i, f"own {i}\n{boiler}" if i < 1_100 else f"other {i}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "host") for i in range(12_000)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "base_failed", "kept", "lost_words").collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == set(range(1_100)) == {r.doc_id for r in got if r.lost_words}


PEOPLE = [
    (1, "Write to Mary Smith or bob.42@Mail8.example.com, +1 (988) 555-2485 4041894974608795. Smith said BOB.42@mail8.example.com at 10.1.2.3 and 8.8.8.8."),
    (2, "4111 1111 1111 1111 and 4111111111111111, GB82 WEST 1234 5698 7654 32; Herr Müller; Анна Иванова; Ελένη ΠΑΠΑΣ 123-45-6789"),
    (3, None), (4, "Version 1.2.3 with 4.0. nothing here; call 911, in 1999-2004, pi is 3.14159265358979323846"), (5, ""), (6, "bob.42@mail8.example.com; Mr. Smith"), (None, "8.8.8.8"), (6, "bob.42@mail8.example.com; Mr. Smith"), (7, "x" * 300_000 + " 8.8.8.8"),
]


def test_pii(spark):
    table = spark.createDataFrame([(d, t, "en", "s", 1, "u", 2, "h", 3, 4, "f") for d, t in PEOPLE], SCHEMA)
    out = pii.replace_pii(table)
    assert out.columns == [*table.columns, "n_replaced"]
    rows = out.collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(PEOPLE) and got[3].text is None and got[5].text == "" and got[4].text == PEOPLE[3][1]
    assert got[1].n_replaced == {"given": 1, "surname": 2, "email": 2, "phone": 1, "card": 1, "ip": 2}
    one = re.fullmatch(r"Write to (\w+) (\w+) or (\S+), \+1 \((\d{3})\) (\d{3})-(\d{4}) (\d{16})\. (\w+) said (\S+) at 10\.(\d+)\.(\d+)\.(\d+) and (\S+)\.", got[1].text)
    ends = lambda name, *kind: name.endswith(tuple(pii.ENDINGS[kind]))
    assert ends(one[1], "latin", "f") and one[1] not in pii.GIVEN["latin", "f"] and one[2] == one[8] != "Smith" and one[3] == one[9] and one[13] != "8.8.8.8"
    assert got[6].text == f"{one[3]}; Mr. {one[2]}" and got[None].text == one[13] and got[7].text.endswith(" " + one[13])
    two = re.fullmatch(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) and (\d{16}), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d); Herr (\w+); (\w+) (\w+); (\w+) (\w+) (\d{3}-\d\d-\d{4})", got[2].text)
    assert "".join(two.groups()[:4]) == two[5] and ends(two[8], "cyrillic", "f") and ends(two[10], "greek", "f") and two[11].isupper()
    digits = [int(c) for c in two[5]]
    assert sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0
    iban = two[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    again = pii.replace_pii(table.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert pii.replace_pii(table.where("doc_id = 1"), key="other").first().text != got[1].text
    assert pii.replace_pii(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pii_names_after_cues(spark):
    """Names beside the list: what announces them is enough, and one name gets one surrogate in all documents."""
    texts = ["My name is Zorblat Quimby. Quimby was here.", "Contact: Xenia-Marie O'Hara, please", "Sincerely,\nZorblat Quimby", "My name is not important. The contact: none", "Dear Alice Zorblat and Anna Smith", "Alice Roe. Anna Roe."]
    rows = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    one = re.fullmatch(r"My name is (\w+) (\w+)\. (\w+) was here\.", rows[0].text)
    assert one[2] == one[3] != "Quimby" and one[1] != "Zorblat" and rows[2].text == f"Sincerely,\n{one[1]} {one[2]}"
    assert re.fullmatch(r"Contact: (\S+) (\S+), please", rows[1].text) and "Hara" not in rows[1].text and "Xenia" not in rows[1].text
    assert rows[3].text == texts[3] and not rows[3].n_replaced
    last = re.fullmatch(r"(\w+) (\w+)\. (\w+) (\w+)\.", rows[5].text)
    five = re.fullmatch(r"Dear (\w+) (\w+) and (\w+) (\w+)", rows[4].text)
    assert last[2] == last[4] and last[1] != last[3] and five[1] == last[1] and five[3] == last[3] and five[2] == one[1]
    assert not {last[1], last[3]} & {"Alice", "Anna"}


def test_pii_against_brute_force(spark):
    """Every document of the small table: text beside the planted values is untouched, and values map one to one, never to a value that occurs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kinds = {"email": r"[\w.%+-]+@[\w.-]+\w", "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}", "card": r"(?<![\d.,])\d{16}(?![\d.,]?\d)", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"}
    plain = re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items()))
    old, there, back = {r.doc_id: r.text or "" for r in docs.collect()}, {}, {}
    for r in pii.replace_pii(docs.select("doc_id", "text")).collect():
        found = list(plain.finditer(old[r.doc_id]))
        if not found:
            assert (r.text or "") == old[r.doc_id]
            continue
        edges = [0, *(x for m in found for x in m.span()), len(old[r.doc_id])]
        around = [re.escape(old[r.doc_id][a:b]) for a, b in zip(edges[::2], edges[1::2])]
        put = re.fullmatch("".join(a + (f"({kinds[m.lastgroup]})" if m else "") for a, m in zip(around, [*found, None])), r.text)
        assert put, r.doc_id
        for m, new in zip(found, put.groups()):
            assert there.setdefault((m.lastgroup, m[0].lower()), new) == new and back.setdefault((m.lastgroup, new), m[0].lower()) == m[0].lower()
        assert sum(r.n_replaced.values()) == len(found)
    assert len(there) > 10 and not {(k, v) for (k, _), v in there.items()} & set(there)


def test_pii_surrogates_stay_distinct(spark):
    """A generator with very few values: rounds must keep surrogates apart, and off the values that occur."""
    from pyspark.sql import functions as F

    few = lambda kind, norm, key, attempt: F.concat(F.lit("v"), ((F.xxhash64(norm) + attempt) % 7).cast("string"), F.when(F.lit(attempt > 3), F.concat(F.lit("-"), norm, F.lit(attempt))).otherwise(""))
    names = spark.createDataFrame([("ip", f"n{i}") for i in range(60)] + [("ip", "v1"), ("ssn", "v1"), ("ip", "n3")], "kind string, norm string")
    rows = pii.assign(names, "k", few).collect()
    assert len(rows) == 62 and len({(r.kind, r["sub"]) for r in rows}) == 62
    assert not {(r.kind, r["sub"]) for r in rows} & {(r.kind, r.norm) for r in rows}


def test_pii_leaves_no_planted_value(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    find = re.compile(r"\S+@\S+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r.text for r in pii.replace_pii(docs.select("doc_id", "text")).collect()}
    assert old.keys() == new.keys()
    hit = 0
    for d, t in old.items():
        values = find.findall(t)
        hit += bool(values)
        assert (new[d] == t) == (not values)
        assert not any(v in new[d] for v in values)
    assert hit > 20


def test_secrets(spark):
    import random

    rnd = random.Random(12)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    word = lambda n: "".join(rnd.choice(["th", "er", "on", "an", "re", "ing", "ti"]) for _ in range(n))
    rows, planted = [], set()
    for i in range(300):
        secret = hexes(40)
        body = " ".join(word(rnd.randint(1, 3)) for _ in range(30))
        kind = i % 5
        if kind == 0:
            planted.add(secret)
            body += f' token = "{secret}" ' + word(2)
        elif kind == 1:
            body += " " + word(9) + " " + word(2)
        elif kind == 2:
            body += " " + "".join(rnd.choice("0123456789") for _ in range(16))
        rows.append((i, body, "src/main.py" if i % 2 else "docs/examples/a.md"))
    rows += [(None, f"password={hexes(18)}", None), (500, None, "x"), (501, "", "x"), (502, "a" * 50_000, "x"), (3, rows[3][1], "x")]
    table = spark.createDataFrame([(d, t, "en", s, 1, "u", 2, "h", 3, 4, "f") for d, t, s in rows], SCHEMA).repartition(3)
    got = secrets.scan_secrets(table).collect()
    assert planted <= {r.value for r in got if r.kept}
    assert not any(r.kept for r in got if r.value.isalpha() or r.value.isdigit())
    assert {r.doc_id for r in got if r.kept} == {d for d, t, _ in rows if t and ("token = " in t or "password=" in t)}
    assert all(0 <= r.score <= 1 for r in got) and 502 in {r.doc_id for r in got}
    again = secrets.scan_secrets(table.repartition(2)).collect()
    assert sorted((r.value, r.kept) for r in again) == sorted((r.value, r.kept) for r in got)
    # Labelled findings given by a user are what counts: here all tokens in hex are said to be no secrets.
    labels = spark.createDataFrame([(s, 0) for s in planted] + [(r.value, 1) for r in got if r.value.isdigit()], "value string, label int")
    taught = secrets.scan_secrets(table, labels).collect()
    assert not any(r.kept for r in taught if r.value in planted) and all(r.kept for r in taught if r.value.isdigit())
    assert secrets.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = secrets.scan_secrets(spark.createDataFrame([(1, "password=abc123def456", None, None, 1, "u", 2, "h", 3, 4, "f")], SCHEMA)).collect()
    assert [(r.value, r.kept) for r in alone] == [("abc123def456", True)]
    one_class = secrets.scan_secrets(table, labels.where("label = 0")).collect()
    assert len(one_class) == len(got) and not any(r.kept for r in one_class)


def test_secrets_held_out(spark):
    """Precision and recall on planted findings in surroundings that the forest hasn't seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secrets.held_out_scores(docs).collect()
    right, said, there = sum(r.kept for r in rows if r.label), sum(r.kept for r in rows), sum(r.n for r in rows if r.label)
    assert there > 100 and right / said > 0.95 and right / there > 0.95, rows


def test_secrets_against_brute_force(spark):
    """All candidates of the small table, found with plain Python, and the planted keys and tokens among them kept, nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.scan_secrets(docs).collect()
    lone, names = re.compile(r"[A-Za-z0-9+/_~-]{16,}={0,2}"), re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_key|apikey|access_key|auth_token|credential)['\"]?\s?[:=]\s?['\"]?([^\s'\"]{8,})")
    want, secret = [], set()
    for r in docs.collect():
        text, at, n = r.text or "", 0, 0
        while at < len(text):
            spans = [(m.start(), m.end(), m[1]) for m in [names.search(text, at)] if m]
            m = lone.search(text, at)
            while m and (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "+/_~-") or text[m.end() : m.end() + 1].isalnum()):
                m = lone.search(text, m.end())
            spans += [(m.start(), m.end(), m[0])] if m else []
            if not spans:
                break
            start, at, value = min(spans)
            want.append((r.doc_id, n, value))
            n += 1
        secret |= {(r.doc_id, v) for v in re.findall(r"AKIA[0-9A-Z]{16}|(?:password=|token = \")([0-9a-f]+)", text) if v} | {(r.doc_id, v) for v in re.findall(r"AKIA[0-9A-Z]{16}", text)}
    assert sorted((r.doc_id, r.ordinal, r.value) for r in got) == sorted(want)
    assert {(r.doc_id, r.value) for r in got if r.kept} == secret and len(secret) > 10


def test_secret_names(spark):
    """The announcing word may end a longer name; the value is the candidate and not the name."""
    texts = {
        "DB_PASSWORD=hunter2pass1": ["hunter2pass1"], 'dbPassword = "s3cr3tPass99"': ["s3cr3tPass99"], "client_secret=ab12cd34ef56": ["ab12cd34ef56"],
        'MYSQL_ROOT_PASSWORD: "Tr0ub4dor&3x"': ["Tr0ub4dor&3x"], 'MYSQL_ROOT_PASSWORD="Tr0ub4dor&3x"': ["Tr0ub4dor&3x"], "spring.datasource-main.password=ab12cd34ef56": ["ab12cd34ef56"], "password=abc123def456": ["abc123def456"],
        "MYSQL_ROOT_PASSWORD is set": ["MYSQL_ROOT_PASSWORD"], "0123456789abcdef==": ["0123456789abcdef=="], "DB_PASSWORD=short": [],
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {i: [] for i in range(len(texts))}
    for r in secrets.candidates(docs).orderBy("doc_id", "ordinal").collect():
        got[r.doc_id].append(r.value)
    assert list(got.values()) == list(texts.values())
    kept = {r.value for r in secrets.scan_secrets(docs).collect() if r.kept}
    assert {v for t, vs in texts.items() for v in vs if "is set" not in t and "==" not in t} <= kept
