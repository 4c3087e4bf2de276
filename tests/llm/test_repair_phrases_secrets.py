import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablero.llm import op11_repair as op11
from tablero.llm import op12_collocations as op12
from tablero.llm import op13_secrets as op13

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK = re.compile("^[\x20\x09-\x0d]*$")
GRAMMAR = re.compile("(s?(ua)+)?")
CONVERSATIONS = "conv_id long, turn long, role string, text string, extra int, copies long, of long"


# --- conversation repair ---------------------------------------------------------------------------------------------


def after_damage(rows):
    """Rows of one conversation (conv, turn, role, text) in their order after damage, by the definition."""
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def marked(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every_repair(rows, most_inserted=3):
    """The least (cost, audit) over all edit sequences with at most ``most_inserted`` insertions in one place, and its lines."""
    best = None

    def go(i, inserted, cost, audit, initials, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not GRAMMAR.fullmatch(initials + "ua") and not GRAMMAR.fullmatch(initials + "a"):
            return
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, 0, cost + 3, audit + "D", initials, lines)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    go(i + 1, 0, cost + more, audit + "K", initials + role[0], [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, 0, cost + 2 + more, audit + "R", initials + new[0], [*lines, f"{new}:{text}"])
        if inserted < most_inserted:
            for new in ("user", "assistant"):
                go(i, inserted + 1, cost + 2, audit + "I", initials + new[0], [*lines, f"{new}:"])

    go(0, 0, 0, "", "", [])
    return best


def wanted(conv, rows, repair):
    turns = [t for t, *_ in rows if t is not None]
    faults = Counter(f for *_, f in marked(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = repair(marked(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_suffixes(rows):
    """Least (cost, audit) by whole suffix strings, for conversations that are too long for every_repair."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}
    best = {"": (0, "", []), "a": (0, "", [])}

    def closed(at):
        for _ in range(2):
            for top in step:
                asked = step[top][-1]
                if asked in at:
                    with_new = (at[asked][0] + 2, "I" + at[asked][1], [f"{role_of[asked]}:", *at[asked][2]])
                    at[top] = min(at.get(top, with_new), with_new, key=lambda x: x[:2])
        return at

    best = closed(best)
    for role, text, fault in reversed(rows):
        new = {}
        for top in step:
            options = [(best[top][0] + 3, "D" + best[top][1], best[top][2])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in step[top]:
                    on = best[role[:1]]
                    options.append((on[0] + more, "K" + on[1], [f"{role}:{text}", *on[2]]))
                asked = step[top][-1]
                on = best[asked]
                options.append((on[0] + 2 + more, "R" + on[1], [f"{role_of[asked]}:{text}", *on[2]]))
            new[top] = min(options, key=lambda x: x[:2])
        best = closed(new)
    return best[""]


def said(rng):
    return rng.choice(["Yes.", "no", "why?", "Go!  ", "", " \t\n", "a. b", "end.\n", "x\x85", "ok."])


def test_repair_against_all_edit_sequences(spark):
    rng, rows = random.Random(3), []
    for conv in range(70):
        for _ in range(rng.randint(1, 4)):
            turn = rng.choice([None, *range(5)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([None, said(rng), said(rng)])))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "no"), rows[5], rows[5]]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONVERSATIONS).repartition(3)
    got = sorted((tuple(r) for r in op11.repair(table).collect()), key=str)
    per = defaultdict(list)
    for r in rows:
        per[r[0]].append(r)
    want = sorted((wanted(conv, after_damage(own), every_repair) for conv, own in per.items()), key=str)
    assert got == want
    assert any("I" in w[7] for w in want) and any("R" in w[7] for w in want)


def test_repair_of_a_conversation_that_spreads_over_ranges(spark):
    rng, rows = random.Random(4), []
    for turn in range(700):
        rows.append((7, turn // 2 if turn < 600 else None, rng.choice(["user", "assistant", "system", "bot"]), rng.choice([said(rng), f"text {turn}.", f"text {turn}", f"{turn} " * 50 + "."])))
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"{t}!") for t in range(40)]
    rows += [(9, 1, "user", "same.")] * 300
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONVERSATIONS).repartition(5)
    got = {r["conv_id"]: tuple(r) for r in op11.repair(table).collect()}
    for conv in (7, 8, 9):
        assert got[conv] == wanted(conv, after_damage([r for r in rows if r[0] == conv]), by_suffixes)


def test_repair_pieces_join_to_the_whole():
    import pandas as pd

    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suabx"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 0, 3])) for _ in range(rng.randint(2, 9))]
        cut = rng.randint(1, len(rows) - 1)
        pieces = []
        for no, part in enumerate((rows[:cut], rows[cut:])):
            piece = op11._Piece(1, no, False)
            piece.rows = part
            pieces.append(piece.result(True))
        frame = pd.DataFrame(pieces, columns=list(op11.PIECE))
        joined = op11._joined(frame)
        assert (joined["cost"][0], joined["audit"][0]) == op11.parsed(rows).best()


def test_repair_of_an_empty_table(spark):
    assert op11.repair(spark.createDataFrame([], CONVERSATIONS)).collect() == []


# --- phrases ---------------------------------------------------------------------------------------------------------


def phrases_by_counting(rows, least, first, share=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        found = []
        for p, a in cands.items():
            if p in around and 100 * around[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng, rows = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "the", "THE", "x" * 300]
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            text += " one fine day in the long year " * rng.randint(1, 4)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("fr", "!!!"), ("en", "big long words " * 3000), ("de", "a b. " * 4000), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("numbered,bucket_tokens,portion", [(op12.NUMBERED, 4_000_000, 4_000_000), (5, 900, 5000), (op12.NUMBERED, 500, 3000)])
def test_collocations_against_counting(spark, phrase_rows, monkeypatch, numbered, bucket_tokens, portion):
    monkeypatch.setattr(op12, "PORTION", portion)
    monkeypatch.setattr(op12, "BLOCK", 3000)
    docs = spark.createDataFrame([(i, t, g, 1, 2, 3, "k") for i, (g, t) in enumerate(phrase_rows)], "doc_id long, text string, lang string, f int, n int, a int, key string").repartition(3)
    got = sorted(tuple(r) for r in op12.collocations(docs, least=12, first=40, numbered=numbered, bucket_tokens=bucket_tokens).collect())
    assert got == phrases_by_counting(phrase_rows, 12, 40)
    assert {r[0] for r in got} >= {"en", "de", "und"}


@pytest.mark.parametrize("numbered", [200, 2])
def test_collocations_of_languages_named_like_words(spark, numbered):
    rows = [(g, f"{a} {b} {a} x{g}y {b} {a}, {b} {a} {b}") for g in ("es", "de", "DE", "und", None) for a in ("es", "de", "und") for b in ("de", "es") for _ in range(5)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in op12.collocations(docs, least=12, first=40, numbered=numbered).collect())
    assert got == phrases_by_counting(rows, 12, 40)


def test_multikey_quicksort_counts_prefixes(monkeypatch):
    monkeypatch.setattr(op12, "SMALL", 8)
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, (5000, op12.DEPTH)).astype(np.uint64)
    s[:, :2] += 1
    for d in range(1, op12.DEPTH):
        s[s[:, d - 1] == 0, d] = 0
    s, weights = op12.fold(s)
    want = Counter()
    for row, w in zip(s.tolist(), weights.tolist()):
        for k in range(2, op12.DEPTH + 1):
            if row[k - 1]:
                want[tuple(row[:k])] += w
    got = dict(op12.multikey_quicksort(s, weights, 40, []))
    assert got == {p: a for p, a in want.items() if a >= 40}
    edge = s[len(s) // 2]
    along = dict(op12.multikey_quicksort(s, weights, 1000, [edge]))
    assert all(along[tuple(edge[:k].tolist())] == want[tuple(edge[:k].tolist())] for k in range(2, op12.DEPTH + 1) if edge[k - 1])


def test_collocations_of_nasty_and_empty_tables(nasty, empty):
    assert op12.collocations(empty).collect() == []
    assert op12.collocations(nasty, least=2).count() > 0


def test_packed_suffixes_round_trip():
    for high in (1000, 2**63):
        s, w = op12.fold(np.random.default_rng(1).integers(1, high, (100, op12.DEPTH), dtype=np.uint64))
        got = op12.unpack(op12.pack(s, w))
        assert (got[0] == s).all() and (got[1] == w).all()


# --- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def live_looking(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 10 and not re.search(op13.PLACEHOLDER, v))


def scanned(rows):
    """Per (doc, text, source) row the result by the definition."""
    spans = []
    for _, text, _ in rows:
        own = base_spans(text or "")
        bare = [(m.start(), 3, m.end(), "owned", m[0]) for m in re.finditer(op13.BARE, text or "") if live_looking(m[0])]
        spans.append(own + [b for b in bare if not any(s[0] < b[2] and s[2] > b[0] for s in own)])
    owners = defaultdict(set)
    for (_, _, source), own in zip(rows, spans):
        for s in own:
            owners[s[4]].add(source)
    out = []
    text_of = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(xs))
    for (doc, _, _), own in zip(rows, spans):
        live = [s for s in own if len(owners[s[4]]) == 1 and live_looking(s[4])]
        kept = [s for s in own if s[1] < 3 or s in live]
        kinds = Counter(s[3] for s in own)
        base = text_of([s for s in own if s[1] < 3])
        out.append((doc, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest(), text_of(kept), sum(s[1] == 3 for s in kept), len(live), sum(len(owners[s[4]]) >= 3 for s in kept), text_of(live)))
    return sorted(out, key=str)


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(6)
    key = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz123456789"
    shared, rows = key(40), []
    for i in range(160):
        parts = [rng.choice([
            f'token = "{key(40)}"', f"PassWord:{key(rng.randint(6, 10), mixed)}", f"AKIA{key(rng.randint(9, 16), 'ABCDEFGHJKMN234567')}", key(rng.randint(28, 36)), f"api_key='{shared}'", "token=secret=abcdefghij",
            "password: token: abcdefgh1", key(24, mixed), f"é😀{key(30, mixed)}", "YOUR_EXAMPLE_KEY_1234567890", "secret", "x" * 40, f"aakia AKIAAKIA{key(8, 'AKIB29')}", f"passwd {shared} token", "ſecret=abcdefgh12",
        ]) for _ in range(rng.randint(0, 12))]
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", ", "]).join(parts) if i % 11 else None, f"s{i % 5}" if i % 7 else None))
    rows += [(1000, "", "s1"), (1001, f"token={shared} " * 700 + key(33), "s2"), rows[2], rows[2]]
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, source string, row int, base int, hash string").repartition(3)
    got = sorted((tuple(r) for r in op13.secrets(docs).collect()), key=str)
    assert got == scanned(rows)
    assert any(r[6] for r in got) and any(r[8] for r in got)


def test_secrets_plan_has_no_python(spark, nasty, empty):
    assert op13.secrets(empty).collect() == []
    got = op13.secrets(nasty)
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    assert got.count() == nasty.count()
