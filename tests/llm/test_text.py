"""Personal items, splitting, packing, leaks and subjects."""

import random
import string

import numpy as np
import pytest

from recollect.llm import leaks, packing, pii, splitting, subjects

CASES = [
    ("Reach R. Marchbanck on +1 772 555 0192 or ottilie52@ulmamere.example.org.", ["name:R. Marchbanck", "phone:+1 772 555 0192", "email:ottilie52@ulmamere.example.org"]),
    ("So I told Drummick, Ivo that Wexuster is too far.", ["name:Drummick, Ivo"]),
    ("My name is Karla Tessbrook.", ["name:Karla Tessbrook"]),
    ("mail katell.orrinck (at) greanay-post[dot]invalid now", ["email:katell.orrinck (at) greanay-post[dot]invalid"]),
    ("write to memo at mail dot braarquist dot invalid, please", ["email:memo at mail dot braarquist dot invalid"]),
    ("Let us meet at Pellimmond dot map. Use @Linemdale. The build release@v2.28 failed at 12:24.", []),
    ("passport no. CD 9354859, SSN 666-61-1347, NINO QQ 26 74 24 C before noon", ["id_number:CD 9354859", "id_number:666-61-1347", "id_number:QQ 26 74 24 C"]),
    ("a passport in 73 years; Order no. 2059-8688; Ticket 555-82-91 in version 10.2.74.52; 4096 tokens, about 6970 5515 bytes", []),
    ("Call five five five, zero one three seven after six.", ["phone:five five five, zero one three seven"]),
    ("Ship it to Flat 6, 239 Mavendan Road, Norentane, please.", ["address:Flat 6, 239 Mavendan Road, Norentane"]),
    ("Vivo en Calle Ulmarby 602, 2º B, Kedortane", ["address:Calle Ulmarby 602, 2º B, Kedortane"]),
    ("in der Jasatanestraße 272, 01678 Moremhaven.", ["address:Jasatanestraße 272, 01678 Moremhaven"]),
    ("We met Ostesdale Press on Fenulhaven Street last February 9. The film Mavrinay Lane runs at 8 in room 81. On November 8 lists one court.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_find_pii(text, want):
    assert [f"{k}:{text[s:e]}" for s, e, k in pii.find_pii(text)] == want


@pytest.mark.parametrize("text,want", [
    ("I met Karla Tessbrook yesterday", ["Karla Tessbrook"]),
    ("Regards, John Miller", ["John Miller"]),
    ("from: Aline de Vries <a@b.example>", ["Aline de Vries"]),
    ("Emergency contact Miller, John: 030/23125601", ["Miller, John"]),
    ("Someone saw Karla N. Tessbrook there. When Omar Haddad phoned, it rang.", ["Karla N. Tessbrook", "Omar Haddad"]),
    ("I had lunch with John Smith and Maria Garcia", ["John Smith", "Maria Garcia"]),
    ("It was Wei Zhang; SMITH, JOHN agreed, j. smith did not.", ["Wei Zhang", "SMITH, JOHN", "j. smith"]),
    ("Dr. Ελένη Παππά und Frau Доктор Ирина Петрова", ["Ελένη Παππά", "Доктор Ирина Петрова"]),
    ("my name is john smith and I like it. My name is spelled wrong.", ["john smith"]),
    ("my name is 李小龙", ["李小龙"]),
    ("We met Pellimmond Press on Fenulhaven Street. I told Harbour Trust. Between Jasarthorpe and When Mavolock Foundry told us, on June 2.", []),
])
def test_names_outside_the_lists(text, want):
    assert [text[s:e] for s, e, k in pii.find_pii(text) if k == "name"] == want


@pytest.mark.parametrize("text,want", [
    ("Call nine eight seven six four three two two oh two.", "phone:nine eight seven six four three two two oh two"),
    ("It is two-four-two-six-seven-eight-nine.", "phone:two-four-two-six-seven-eight-nine"),
    ("NIE: X1234567L", "id_number:X1234567L"),
    ("SIN: 046454286", "id_number:046454286"),
    ("TIN#046454286", "id_number:046454286"),
    ("Pay to DE89 3704 0044 0532 0130 00 today", "id_number:DE89 3704 0044 0532 0130 00"),
])
def test_other_items(text, want):
    assert [f"{k}:{text[s:e]}" for s, e, k in pii.find_pii(text)] == [want]


def test_names_are_learned(spark):
    """Names that stand where names do are found elsewhere too; words of places and firms are not learned."""
    given, last = ["Zorvane", "Quillip", "Ésaline"], ["Tebbermoss", "O'Drannick", "Vell-Harrow"]
    rows = [f"Regards, {g} {n}" for g in given for n in last] * 3
    rows += [f"We met {p} Press near {p} Street." for p in ("Ostermoor", "Pellwick")] * 20
    plain = ["then zorvane tebbermoss slept", "So Quillip O’Drannick, Vell-Harrow, Ésaline and T. Tebbermoss's dog", "Ostermoor Pellwick was empty", "Zorvane Street"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows + plain)] + [("x", None), ("y", "")], "id string, content string")
    learned = pii.learn(df, "content")
    assert learned == {**dict.fromkeys(map(pii._plain, given), pii.GIVEN), **dict.fromkeys(map(pii._plain, last), pii.LAST)}
    lexicon = pii.Lexicon(learned)
    got = [[t[s:e] for s, e, _ in pii.find_pii(t, lexicon)] for t in plain]
    assert got == [["zorvane tebbermoss"], ["Quillip O’Drannick", "Vell-Harrow, Ésaline", "T. Tebbermoss"], [], []]
    assert [t[s:e] for t in plain for s, e, _ in pii.find_pii(t)] == ["T. Tebbermoss's"]
    assert pii.learn(df.where("false"), "content") == {}
    items = pii.pii_items(df, "id", "content", "k", learned).where(f"rec_id = '{len(rows)}'").collect()
    assert [(x.start_pos, x.end_pos, x.pii_type) for x in items] == [(5, 23, "name")]
    clean = {r.id: r.content for r in pii.redacted(df, "content", "k", learned).collect()}
    assert clean[str(len(rows))] == f"then <NAME:{items[0].surrogate}> slept" and clean["x"] is None and clean["y"] == ""


def test_surrogates_in_other_scripts():
    s = pii.Surrogates(b"key")
    for kind, value in (("email", "иван@почта.рф"), ("phone", "+٩٦٦ ٥٠ ١٢٣ ٤٥٦٧"), ("phone", "＋８１ ３ １２３４ ５６７８"), ("email", "mail@mail.com"), ("name", "李 小龍"), ("name", "Éé Öö")):
        assert s.of(kind, value) != value
    phone = s.of("phone", "٠٥٠ ١٢٣ ٤٥٦٧")
    assert len(phone) == 12 and all("٠" <= c <= "٩" for c in phone.replace(" ", ""))
    assert s.of("email", "иван@почта.рф")[:4].isalpha() and pii.redact("mail иван@почта.рф", s).count("иван") == 0
    for letters in ("0123456789", "٠١٢٣٤٥٦٧٨٩", "абвгдежз", "éèêö", "bcdf"):
        out = [s._format(a + b, letters=True) for a in letters for b in letters]
        assert len(set(out)) == len(out) and all(o != a + b for o, (a, b) in zip(out, ((a, b) for a in letters for b in letters)))


def test_surrogates():
    s = pii.Surrogates(b"key")
    assert s.of("name", "Zoe Drummick").split() == s.of("name", "Drummick, Zoe").replace(",", "").split()[::-1]
    assert s.of("email", "zoë.drummick@x.example").split("@")[0] == ".".join(s.of("name", "zoë drummick").split())
    assert pii._fold(s.of("name", "Zoë Drummick")) == pii._fold(s.of("name", "Zoe Drummick")) and s.of("name", "Zoë Drummick").split()[0][-1] == "ë"
    for w in ("Zoe Drummick", "ŁUKASZ Ünver", "Ελένη Παππά", "Ирина Петрова"):
        out = s.of("name", w)
        assert len(out) == len(w) and all(a.isupper() == b.isupper() and a.isalpha() == b.isalpha() and pii._alphabet(pii._base(a)[0]) == pii._alphabet(pii._base(b)[0]) for a, b in zip(w, out))
        assert all(a != b for a, b in zip(w.split(), out.split()))
    assert s.of("name", "JOHN SMITH") == s.of("name", "John Smith").upper() and s.of("name", "Velda Orrinck").split()[0].endswith("a")
    assert s.of("name", "Ivo Drummick").split() == s.of("name", "Drummick, Ivo").replace(",", "").split()[::-1]  # coreference
    assert s.of("name", "IVO DRUMMICK") == s.of("name", "Ivo Drummick").upper()
    assert s.of("name", "Emma Orrinck").split()[0] in pii.FEMALE and s.of("name", "Thomas Orrinck").split()[0] in pii.MALE
    values = [f"{n:07d}" for n in range(0, 3000, 7)]
    out = [s.of("phone", v) for v in values]
    assert len(set(out)) == len(values) and all(len(o) == 7 and o.isdigit() for o in out) and out != values
    assert pii.Surrogates(b"other").of("phone", values[3]) != out[3]
    names = {s.of("name", f"{a} {b}") for a in pii.FEMALE + pii.MALE for b in pii.SURNAMES}
    assert len(names) == len(pii.FEMALE + pii.MALE) * len(pii.SURNAMES)
    text = "x" * 200_000 + " Ask for Ilka Thackwray at the desk. " + "y " * 100_000
    clean = pii.redact(text, s)
    other = {s.of("name", f"{a} {b}") for a in words(random.Random(1), 40) for b in words(random.Random(2), 40)}
    assert len(other) == 1600
    assert "Thackwray" not in clean and "<NAME:" in clean and clean.startswith("x" * 200_000) and clean.endswith("y " * 100_000)
    assert pii.redact(None, s) is None and pii.redact("", s) == ""


def test_pii_frames(spark):
    rows = [("a", "Ask for Ilka Thackwray.", 1), ("a", "Ask for Ilka Thackwray.", 2), ("b", None, 3), ("c", "", 4), (None, "mail x.y@z.example", 5)]
    df = spark.createDataFrame(rows, "id string, content string, start_pos int")
    items = pii.pii_items(df, "id", "content", "k").collect()
    assert sorted((x[:4] for x in items), key=str) == sorted([("a", "name", 8, 22), (None, "email", 5, 18)], key=str)
    out = pii.redacted(df, "content", "k")
    assert out.columns == df.columns and out.count() == 5 and out.where("content is null").count() == 1
    assert pii.pii_items(df.where("false"), "id", "content", "k").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_split(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Satz. ", "línea\n", "\n\n", "a, b ", "日本語", "🙂", "x" * 50]) for _ in range(r.choice([50, 800, 4000])))
    for limit, overlap in ((500, 50), (40, 5), (9, 0)):
        got = splitting.split_text(text, limit, overlap)
        assert "".join(text[n:e] for _, n, e in got) == text
        assert all(len(text[s:e].encode()) // 4 <= limit for s, _, e in got)
        assert all(s <= n < e and (i == 0 or s >= got[i - 1][1]) for i, (s, n, e) in enumerate(got))
        if overlap and len(got) > 1:
            assert np.mean([len(text[s:n].encode()) / 4 for s, n, _ in got[1:]]) > overlap / 3
    assert splitting.split_text(None) == [] and splitting.split_text("") == []
    assert splitting.split_text("a" * 2003) == [(0, 0, 2003)] and len(splitting.split_text("a" * 2004)) == 2


def test_split_prefers_boundaries():
    text = "\n\n".join("One sentence of a paragraph. " * 12 for _ in range(20))
    got = splitting.split_text(text, 200, 20)
    assert all(n == 0 or text[n - 1] == "\n" for _, n, _ in got)


def test_pieces_frame(spark):
    df = spark.createDataFrame([("a", "w " * 3000, 9), ("a", "w " * 3000, 9), ("b", "short", 9), ("c", None, 9), (None, "z" * 5000, 9)], "id string, content string, piece int")
    got = splitting.pieces(df, "id", "content").collect()
    assert {x.id for x in got} == {"a", None} and all(x.n_tokens <= 500 for x in got)
    assert "".join(("w " * 3000)[x.new_pos : x.end_pos] for x in sorted((x for x in got if x.id == "a"), key=lambda x: x.piece)) == "w " * 3000


def first_fit(sizes, capacity):
    """Contexts that first fit in descending order takes, item by item."""
    room = []
    for size in sorted(sizes, reverse=True):
        k = next((i for i, x in enumerate(room) if x >= size), None)
        if k is None:
            room.append(capacity - size)
        else:
            room[k] -= size
    return len(room)


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing(seed):
    r = random.Random(seed)
    counts = {s: r.randrange(1, 9) for s in r.sample(range(1, 257), 60)}
    out = packing.pack_histogram(counts, 256)
    left = dict.fromkeys(counts, 0)
    for contents, n, _ in out:
        assert sum(contents) <= 256 and n > 0
        for s in contents:
            left[s] += n
    assert left == counts
    used = first_fit([s for s, n in counts.items() for _ in range(n)], 256)
    assert sum(n for _, n, _ in out) <= 1.04 * used + 1


@pytest.mark.parametrize("part_rows", [50, 1_000_000])
def test_pack_frame(spark, part_rows):
    r = random.Random(2)
    rows = [(i, r.choice([3, 3, 3, 100, 700, 2048, 5000, r.randrange(1, 2500)])) for i in range(3000)] + [(9999, 0), (9998, None)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, n_tokens bigint"), part_rows=part_rows).toPandas()
    assert got.groupby("id").n_tokens.sum().to_dict() == {i: n for i, n in rows if n}
    assert got.groupby("context").n_tokens.sum().max() <= 2048 and not got.duplicated(["context", "slot"]).any()
    cut = got[got.part > 0].id.unique()
    assert set(cut) == {i for i, n in rows if n and n > 2048}
    assert got.context.nunique() <= 1.02 * first_fit(got.n_tokens, 2048) + 1
    load = got.groupby("step").context.nunique()
    assert load.max() - load.min() <= 1
    assert packing.pack(spark.createDataFrame([], "id bigint, n_tokens bigint")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = dict(map(tuple, packing.token_counts(df, "doc_id", "text").collect()))
    assert got[1] == 5 and got[2] == 0 and got[3] == 0 and got[4] > 1


def words(r, n):
    return ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(3, 9))) for _ in range(n)]


def item_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, body string")


def brute_run(doc, item):
    """The most consecutive words of the item that the document repeats with at most one in ten edited, by a table over all words of
    both and all numbers of edits."""
    best, top = 0, len(item) // 10 + 1
    state = {}
    for i in range(len(item)):
        for j in range(len(doc)):
            for e in range(top):
                at = []
                if item[i] == doc[j]:
                    at.append(max(state.get((i - 1, j - 1, e), -999), 0 if e == 0 else -999) + 1)
                    if at[-1] > 0 and e <= max(1, (at[-1] + 1) // 10):
                        best = max(best, at[-1])
                if e:
                    at += [state.get((i - 1, j - 1, e - 1), -999) + 1, state.get((i - 1, j, e - 1), -999) + 1, state.get((i, j - 1, e - 1), -999)]
                state[i, j, e] = max(at, default=-999)
    return best


def found(items, docs, min_words=15):
    text, item, n = leaks._search(leaks.build_index(items, min_words), docs, min_words)
    out = {}
    for t, i, k in zip(text.tolist(), item.tolist(), n.tolist()):
        out[t, i] = max(k, out.get((t, i), 0))
    return out


def test_leaks(spark):
    r = random.Random(4)
    vocab = words(r, 400)
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(100 + i, " ".join(say(60))) for i in range(30)]
    docs, want = [], set()
    for i in range(200):
        body, n = say(r.choice([20, 200])), r.choice([0, 8, 12, 20, 40])
        if n:
            item, text = r.choice(items)
            at = r.randrange(60 - n)
            part = text.split()[at : at + n]
            if n >= 20:
                want.add((i, item))
                part[n // 2] = r.choice(["changed", ""])
                part = [w.upper() if k % 3 else f"<b>{w}</b>," for k, w in enumerate(part)]
            body[7:7] = part
        docs.append((i, " ".join(body), 0))
    docs += docs[:20] + [(900, None, 0), (901, "", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, words int")
    items += [(300, items[0][1]), (301, None), (302, ""), (None, "a b"), (303, "too short")]
    want |= {(i, 300) for i, item in want if item == 100}
    for chars in (10**6, 3000):  # one pass, several passes
        got = leaks.leaked_items(df, "doc_id", "text", item_frame(spark, items), "item_id", "body", max_chars=chars)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want and got.count() == len(want)
    assert leaks.leaked_items(df.where("false"), "doc_id", "text", item_frame(spark, items), "item_id", "body").count() == 0
    assert leaks.leaked_items(df, "doc_id", "text", item_frame(spark, items).where("false"), "item_id", "body").count() == 0


@pytest.mark.parametrize("letters", [(1, 2), (3, 9)])
@pytest.mark.parametrize("n", [15, 19, 20, 29, 30])
def test_leaks_with_an_edit_anywhere(n, letters):
    """Edits at every position, altered, lost or added, where the alignment of all words says that the passage is repeated."""
    r = random.Random(n)
    word = lambda: "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(r.randint(*letters)))
    items = [(i, " ".join(word() for _ in range(34))) for i in range(6)]
    docs, want, checked = [], {}, {}
    for k in range(n):
        for edits in range(1, max(1, (n + 1) // 10) + 1):
            for kind in ("alter", "lose", "add"):
                item = r.randrange(6)
                at = r.randrange(34 - n)
                part = items[item][1].split()[at : at + n]
                for p in sorted({(k + x * (n // edits)) % n for x in range(edits)}, reverse=True):
                    part[p : p + (kind != "add")] = [] if kind == "lose" else [word()]
                docs.append(" ".join([word() for _ in range(3)] + part + [word() for _ in range(3)]))
                got = checked[len(docs) - 1, item] = brute_run(docs[-1].split(), items[item][1].split())
                if got >= 15:
                    want[len(docs) - 1, item] = got
    got = found(items, docs)
    assert set(want) <= set(got) and all(got[x] == want[x] for x in want)
    assert all((checked.get(x) or brute_run(docs[x[0]].split(), items[x[1]][1].split())) >= 15 for x in got)
    assert len(want) >= len(docs) // 3


@pytest.mark.parametrize("seed", range(4))
def test_alignment(seed):
    r = random.Random(seed)
    item = np.array([r.randrange(60) for _ in range(50)], np.uint64)
    docs = []
    for _ in range(20):
        part = list(item[(a := r.randrange(30)) : a + r.randrange(5, 20)])
        for _ in range(r.randrange(3)):
            part[r.randrange(len(part))] = 99
        docs.append(np.array([r.randrange(80) for _ in range(10)] + part + [r.randrange(80) for _ in range(10)], np.uint64))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    k, z = len(docs), np.zeros(len(docs), int)
    got = leaks.align(np.concatenate(docs), item, first[:-1], first[1:], z, z + 50, first[:-1] - 50, 110)
    assert got.tolist() == [brute_run(d.tolist(), item.tolist()) for d in docs] and k == 20


def test_leaks_among_repeated_words():
    item = [*map(str, range(16)), *["x"] * 250]
    doc = " ".join([*map(str, range(8)), "y", *map(str, range(8, 16))])
    assert found([(1, " ".join(item))], [doc]) == {(0, 1): 16}


def test_a_shared_passage_is_found_for_all_items():
    r = random.Random(3)
    lead = words(r, 18)
    items = [(i, " ".join(lead + words(r, 30))) for i in range(300)]
    docs = [" ".join(words(r, 10) + lead + words(r, 10)) for _ in range(5)]
    assert set(found(items, docs)) == {(t, i) for t in range(5) for i in range(300)}


def test_subjects(spark):
    r = random.Random(8)
    topics = {n: words(r, 25) for n in ("law", "sport", "music")}
    common = words(r, 30)

    def sentence(t):
        return " ".join(r.choice(common) for _ in range(7)) + " " + " ".join(r.choice(topics[t]) for _ in range(3)) + "." if t else " ".join(r.choice(common) for _ in range(9)) + "."

    rows, truth, labels = [], {}, []
    for i in range(600):
        own = r.sample(sorted(topics), r.choice([0, 1, 1, 2]))
        body = [sentence(r.choice(own) if own else None) for _ in range(14)] + [sentence(None) for _ in range(2)]
        if own and r.random() < 0.3:
            body.append(sentence(r.choice(sorted(set(topics) - set(own)))))  # a passing mention
        r.shuffle(body)
        rows.append((i, " ".join(body), "x"))
        truth[i] = set(own)
        if i < 150:
            labels += [(i, f" {t.upper()}") for t in own] or [(i, None)]
    labels += [(1, "unknown"), (None, "law")]
    df = spark.createDataFrame([*rows, (700, None, "x"), (701, "", "x"), (None, "a b", "x")], "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame(labels, "id bigint, subject string")
    found = subjects.subject_areas(df, "doc_id", "text", lab, sorted(topics)).collect()
    got = {(x.id, x.subject) for x in found if x.id >= 150}
    want = {(i, t) for i in range(150, 600) for t in truth[i]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    assert subjects.subject_areas(df, "doc_id", "text", lab.where("false"), sorted(topics)).count() == 0
    assert subjects.subject_areas(df.where("false"), "doc_id", "text", lab, sorted(topics)).count() == 0


def test_expectation_maximization_learns_words(spark):
    """With few labels most words of a subject are in none of the labelled documents; the others teach them."""
    r = random.Random(5)
    topics = {n: words(r, 120) for n in ("law", "sport", "music")}
    common = words(r, 60)
    rows, truth, labels = [], {}, []
    for i in range(900):
        own = r.choice([*topics, None])
        body = [" ".join(r.choice(common) for _ in range(6)) + (" " + " ".join(r.choice(topics[own]) for _ in range(2)) if own else "") + "." for _ in range(8)]
        rows.append((i, " ".join(body)))
        truth[i] = own
        labels.append((i, own))
    df, scores = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    for n in (30, 40, 48):
        lab = spark.createDataFrame(labels[:n], "id bigint, subject string")
        want, score = {(i, t) for i, t in truth.items() if t and i >= n}, []
        for rounds in (0, 1):
            got = {(x.id, x.subject) for x in subjects.subject_areas(df, "doc_id", "text", lab, sorted(topics), rounds).collect() if x.id >= n}
            score.append(2 * len(got & want) / (len(got) + len(want)))
        scores.append(score)
    assert all(b >= a for a, b in scores) and any(b > a + 0.02 for a, b in scores), scores
