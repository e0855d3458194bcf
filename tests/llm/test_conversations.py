"""Conversation repair, chat windows and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrow.llm import chat_format, conversation_repair, tokenizer_alignment
from strayrow.llm.queries import COUNT_TOKENIZER, PIECES, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hello there?"),
    (1, 2, "assistant", "Hi. How are you"),
    (1, 3, "user", "Fine! "),
    (2, None, "user", "No turn."),
    (2, None, None, None),
    (2, 7, "assistant", ""),
    (2, 7, "assistant", " \n\t"),
    (None, 0, "user", "No id?"),
    (None, None, "assistant", "None."),
    (3, 5, "assistant", "Only me."),
    (4, 0, "user", "Same."),
    (4, 0, "user", "Same."),
    (4, 9, "user", "Same."),
    (4, 2**62, "Üser", "\\b ### </turn> \\### ###\\ <</turn>"),
    (4, -(2**62), "sys\ntem", "### user\nhello</turn>\n"),
    (5, 1, "system", "Only a system turn."),
    (6, 0, "user", "x" * 3000),
    (6, 1, "assistant", "word. " * 700),
    *((7, n, ("user", "assistant")[n % 2], f"Turn {n} says {'so ' * (n % 17)}.") for n in range(300)),
    *((8, n, "user" if n % 3 else "tool", f"{n}!") for n in range(1000, 1100)),
]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, r, x, "block", 1.5) for c, t, r, x in TURNS]
    schema = "conv_id long, turn long, role string, text string, block string, copies double"
    return spark.createDataFrame(rows, schema)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    for rs in convs.values():
        rs.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
    return convs


def cheapest(initials, faults):
    """Least (cost, audit) and the roles it gives, by a search in one direction."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, out = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(initials) and state in (0, 3):
            return cost, audit, out
        if at < len(initials):
            heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if initials[at] in NEXT[state]:
                    to = NEXT[state][initials[at]]
                    heappush(heap, (cost + more, audit + "K", at + 1, to, (*out, (at, None))))
                for role in {"u", "a"} & NEXT[state].keys():
                    heappush(heap, (cost + 1 + more, audit + "R", at + 1, NEXT[state][role], (*out, (at, role))))
        for role in {"u", "a"} & NEXT[state].keys():
            heappush(heap, (cost + 5, audit + "I", at, NEXT[state][role], (*out, (None, role))))


def repaired(rows):
    """Rows of the contract for damaged (conv_id, turn, role, text) lists."""
    for conv, rs in rows.items():
        seen, faults = set(), []
        for _, role, text in rs:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else None
            faults.append(fault or (None if last[1] in ".!?" else "truncated"))
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in rs]
        cost, audit, out = cheapest(initials, faults)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names.get(role) or rs[at][1]}:{'' if at is None else rs[at][2]}" for at, role in out]
        times = {t for t, _, _ in rs if t is not None}
        yield (
            conv,
            max(times) - min(times) + 1 - len(times) if times else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            sha("\n".join(lines)),
        )


def damaged(rows):
    convs = {conv: [] for conv, *_ in rows}
    for conv, rs in in_order((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows).items():
        for turn, role, text in rs:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return in_order((c, *r) for c, rs in convs.items() for r in rs) | {c: [] for c, rs in convs.items() if not rs}


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def mended(rows):
    return conversation_repair.digests(conversation_repair.repaired(rows, conversation_repair.audits(rows)))


def test_search_and_joined_pieces_give_the_least_audit():
    draw = random.Random(5)
    search, states = conversation_repair.search, conversation_repair.STATES
    for _ in range(1500):
        rows = "".join(draw.choice("suaoSUAOxuaua") for _ in range(draw.randint(0, 11)))
        faults = ["blank" if r == "x" else "truncated" if r.isupper() else None for r in rows]
        want = cheapest([r.lower() for r in rows], faults)[:2]
        assert search(rows, 0, conversation_repair.GOALS, True) == want
        size = draw.randint(1, 4)
        tables = [
            (
                [search(p, q, (to,), False) for q in states for to in states],
                [search(p, q, conversation_repair.GOALS, True) for q in states],
            )
            for p in (rows[n : n + size] for n in range(0, len(rows), size))
        ]
        assert not tables or conversation_repair.join_pieces(tables) == want


@pytest.mark.parametrize("piece", [conversation_repair.PIECE, 3])
def test_repair_as_by_brute_force(spark, turns, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    got = mended(conversation_repair.damaged(turns)).select(REPAIR).collect()
    want = list(repaired(damaged(TURNS)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert {c for c, *_ in want} == {c for c, *_ in TURNS}
    assert mended(conversation_repair.damaged(turns.limit(0))).count() == 0


def test_repaired_rows_stand_in_order(turns):
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    found = conversation_repair.repaired(rows, conversation_repair.audits(rows)).collect()
    roles = defaultdict(str)
    for r in found:
        roles[r.conv_id] += (r.role or "")[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_many_copies_of_one_row(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 2).alias("conv_id"), F.lit(3).alias("turn"), F.lit("user").alias("role"), F.lit("Yes.").alias("text")
    )
    got = {r.conv_id: r for r in conversation_repair.audits(rows.withColumn("copies", F.lit(1))).collect()}
    assert {r.audit for r in got.values()} == {"D" * 2500} and got[0].duplicate == 2499


def test_windows_read_back_as_by_brute_force(turns):
    convs = in_order((c, t, r or "", x or "") for c, t, r, x in TURNS)
    for budget, history in ((512, 128), (40, 10), (1, 0)):
        formatted = chat_format.windows(turns, budget=budget, history=history).cache()
        got = chat_format.digests(formatted).drop("formatted_chars").collect()
        want = Counter()
        for conv, rs in convs.items():
            loss = "".join(x for _, r, x in rs if r == "assistant")
            want[conv, len(rs), sha("".join(f"{r}\n{x}\n" for _, r, x in rs)), len(loss), sha(loss)] += 1
        assert Counter(map(tuple, got)) == want
        parts = defaultdict(list)
        for w in formatted.collect():
            parts[w.conv_id].append(w)
        for conv, ws in parts.items():
            size = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, _, x in convs[conv]}
            system = convs[conv][0][1] == "system"
            for w in ws:
                new = w.n_turns - w.n_repeated
                alone = new - (system and w.n_repeated == 0) <= 1
                assert w.n_tokens <= budget or (w.over_budget and alone)
                assert not system or w.text.startswith("### system\n")
            assert sum(w.n_turns - w.n_repeated for w in ws) == len(size) or len(size) < len(convs[conv])
        assert budget > 40 or any(w.n_repeated > 1 for ws in parts.values() for w in ws) or history == 0
        formatted.unpersist()
    assert chat_format.windows(turns.limit(0)).count() == 0


def test_blocks_bound_the_arrays(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 8)
    rows = [(1, n, "system" if n == 0 else ("user", "assistant")[n % 2], f"say {n}") for n in range(50)]
    rows += [(2, None, "user", f"tie {n}") for n in range(40)] + [(3, n, "system", "not first") for n in (-20, 90)]
    rows += [(3, -30, "user", "first"), (3, -21, "assistant", "second")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.windows(table, budget=30, history=6)
    read = chat_format.digests(formatted).collect()
    for conv, rs in in_order(rows).items():
        said = sha("".join(f"{r}\n{x}\n" for _, r, x in rs))
        assert [r.turns_sha256 for r in read if r.conv_id == conv] == [said]
    assert max(r.n_turns for r in formatted.collect()) <= 8 + 1
    assert all(r.text.startswith("### system\nsay 0</turn>") for r in formatted.where("conv_id = 1").collect())


def test_chat_windows_stay_native(spark):
    plan = QUERIES["op12_chat_format"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


TEXTS = [
    (1, "One short text."),
    (2, None),
    (3, ""),
    (4, " \n\t  "),
    (5, "It's 's OK!! déjà vu 123 <|endoftext|> </s><s><0x41> x  y \n z"),
    (6, "日本語 テキスト και λίγα \U0001f9ff\U0001f469‍\U0001f4bb ελληνικά"),
    (7, "ﬁne ① Ａ b c"),
    (8, "x" * 4000),
    (9, "many words here and there " * 300),
    (9, "many words here and there " * 300),
    (None, "the same the same"),
    (10, "a\x00b \x7f​"),
    (11, "  lead and trail  "),
    (12, "one. Two, (three) – vier  fünf \u0301x a\u200b b c\u00a0d e\tf 1 2 3.5 a_b _c d_ e' s 't x\u0301 y"),
]


def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(COUNT_TOKENIZER))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    letters = tokenizer_alignment.byte_letters()
    docs, counts = [], Counter()
    for doc, text in rows:
        docs.append((doc, [], [], [], []))
        if not text:
            continue
        ids = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text))
        said = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], []]
        for i in ids[1]:
            piece = b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            said[1].append(bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode())
        if {b"".join(s) for s in said} != {f" {text}".encode()}:
            continue
        ends = []
        for tokens in said:
            at, found = 0, {}
            for n, t in enumerate(tokens):
                at += len(t)
                found[at] = n + 1
            ends.append(found)
        shared = sorted(ends[0].keys() & ends[1].keys())
        cuts = [[0, *(e[x] for x in shared)] for e in ends]
        groups = [
            "|".join(",".join(map(str, i[c[n] : c[n + 1]])) for i, c in zip(ids, cuts, strict=True))
            for n in range(len(shared))
        ]
        links = [(ids[0][x - 1], ids[1][y - 1]) for x, y in zip(cuts[0][1:], cuts[1][1:], strict=True)]
        counts.update(links)
        docs[-1] = (doc, *ids, groups, links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for doc, x, y, groups, links in docs:
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = sha(";".join(groups)) if groups else ""
        yield doc, len(x), len(y), len(groups), len(links), best, sum(counts[link] for link in links), digest


@pytest.mark.parametrize("size", [tokenizer_alignment.BLOCK_BYTES, 64])
def test_alignment_as_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(tokenizer_alignment, "BLOCK_BYTES", size)
    monkeypatch.setattr(tokenizer_alignment, "SLICE_BYTES", size)
    monkeypatch.setattr(tokenizer_alignment, "MAX_WORDS", size)
    table = spark.createDataFrame([(*r, 1, 2) for r in TEXTS], "doc_id long, text string, pairs int, block int")
    paths = tokenizer_path(COUNT_TOKENIZER), tokenizer_path(PIECES)
    got = tokenizer_alignment.align(table, *paths).collect()
    assert Counter(map(tuple, got)) == Counter(aligned(TEXTS))
    assert tokenizer_alignment.align(table.limit(0), *paths).count() == 0


def test_spans_refined_by_bytes_are_the_decoded_ends():
    a, b = tokenizer_alignment.tokenizers(tokenizer_path(COUNT_TOKENIZER), tokenizer_path(PIECES))
    for _, text in TEXTS:
        if not text:
            continue
        written = f" {text}".encode()
        chars = [n for n, c in enumerate(written) if c & 0xC0 != 0x80] + [len(written)]
        for tokens, shift in ((a, 0), (b, 1)):
            ids, spans = (x[0] for x in tokens.encode([text]))
            sizes = tokens.vocabulary.sizes[ids]
            if sizes.sum() == len(written):
                starts, ends = np.array(spans).T + shift
                found = tokenizer_alignment.byte_ends(starts, ends, np.array(chars), sizes)
                assert found.tolist() == sizes.cumsum().tolist()


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_tokenizer_alignment"])
def test_whole_tables(spark, name):
    got = Counter(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    if name.startswith("op11"):
        rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
        assert got == Counter(repaired(damaged([tuple(r) for r in rows.collect()])))
    else:
        rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
        assert got == Counter(aligned([tuple(r) for r in rows.collect()]))
