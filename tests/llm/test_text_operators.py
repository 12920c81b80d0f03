"""Row-wise operators: personal data, secrets, tokens, decontamination, chat."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import rows
import tiktoken
from hypothesis import given, settings, strategies as st

from fanchart.llm import bpe, chat, decontaminate, pii, secrets
from fanchart.llm.queries import PATTERN, VOCABULARY

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract read literally."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((k, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-_%+0123456789 ()é", max_size=60))
def test_base_spans_are_the_literal_ones(text):
    assert pii.find_spans(text)[0] == plain_spans(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("to pаul@exаmple.com!", "email", "pаul@exаmple.com"),
        ("user@exam​ple.com", "email", "user@exam​ple.com"),
        ("call plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("host 10 [.] 0 [.] 0 [.] 1", "ip", "10 [.] 0 [.] 0 [.] 1"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, more = pii.find_spans(text)
    assert (pii.KINDS.index(kind), text.index(found), text.index(found) + len(found)) in more


def test_prose_has_no_added_spans():
    assert pii.find_spans("One of them looked at me. Two or three dot the page at noon; see you at five.") == ([], [])


def test_personal_data_of_edges(spark):
    texts = [*rows.EDGES, "a@b.c " * 3000, "1" * 100_000]
    got = pii.personal_data(rows.documents(spark, texts)).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.base_sha256 for r in got[: len(rows.EDGES)]] == [empty] * len(rows.EDGES)
    assert got[-2].n_email == 3000 and got[-1].n_card == 0
    assert pii.personal_data(rows.documents(spark, [])).count() == 0
    redacted = pii.redact_personal_data(rows.documents(spark, [None, "x a@b.c y"])).orderBy("doc_id").collect()
    assert [r.text for r in redacted] == [None, "x [EMAIL] y"]


PLAIN_SECRETS = [
    (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
    (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Pass", "word", "token", "API_KEY", "=", ": ", '"', "AKIA", "ABCDEFGHIJKL0", "abcdef0123456789", "ſ", "K", " ", "zz", "secret"]), max_size=12))
def test_secrets_are_the_literal_ones(parts):
    text = "".join(parts)
    wanted = [(k, *m.span()) for k, (p, f, good) in enumerate(PLAIN_SECRETS) for m in re.finditer(p, text, f) if good(m)]
    assert [s for s in secrets.scanner().scan([text])[0] if s[0] < 3] == wanted


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("and", [b"abc", b"bcd"])
    assert secrets.trigram_query("[0-9a-f]{32,}") is True
    assert secrets.trigram_query("(abc|x?)y") is True
    assert secrets.trigram_query("ab*cde") == b"cde"
    assert secrets.trigram_query("(foo|bar)+") == ("or", [b"foo", b"bar"])


def test_candidates_hold_every_match():
    texts = ["none", "ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "see https://u:passw@host", "xoxb-1234567890ab"]
    spans = secrets.scanner().scan(texts)
    assert [[secrets.KINDS[s[0]] for s in own] for own in spans] == [[], ["code_host"], ["private_key"], ["url_login"], ["chat_app"]]


def test_secrets_of_edges(spark):
    got = secrets.find_secrets(rows.documents(spark, [*rows.EDGES, "f" * 200_000])).orderBy("doc_id").collect()
    assert [r.n_hex for r in got] == [0] * len(rows.EDGES) + [1]
    assert secrets.find_secrets(rows.documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.sentencepiece_model(bpe.read_ranks(VOCABULARY)), PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_tokens_equal_the_library(own, reference, text):
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_white_space_between_chunks(own, reference):
    for a in "\t\n\x0b\x1c\x85\xa0  ":
        for b in "\t \n　":
            text = f"x{a}{b}y {a}{a}{b} z{b}{b}{a}'s!{a}"
            assert own.encode(text) == reference.encode_ordinary(text)


def test_documents_round_trip(spark, own):
    texts = [*rows.EDGES, "ab " * 50_000]
    docs = rows.documents(spark, texts)
    back = bpe.decode_ids(bpe.encode_texts(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in texts]
    digests = bpe.token_digests(docs, VOCABULARY, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(digests, texts):
        ids = own.encode(t or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.token_digests(rows.documents(spark, []), VOCABULARY, PATTERN).count() == 0


def plain_hits(words, patterns):
    hit, items = [False] * len(words), set()
    for item, pattern in patterns:
        for i in range(len(words) - len(pattern) + 1):
            if words[i : i + len(pattern)] == pattern:
                hit[i : i + len(pattern)] = [True] * len(pattern)
                items.add(item)
    return sum(hit), items


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from("abc"), max_size=40),
    st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=4),
)
def test_search_finds_every_window(words, items):
    window = 4
    patterns = []
    for item, text in enumerate(items):
        n = min(window, len(text))
        patterns += [(item, text[s : s + n]) for s in range(len(text) - n + 1)] if n else []
    sets = decontaminate.build_patterns([(i, " ".join(t)) for i, t in enumerate(items)], window)
    flat, found = decontaminate.find_hits([w.encode() for w in words], sets)
    assert (sum(flat[1::2]) - sum(flat[::2]), found) == plain_hits(words, patterns)


def test_contamination_of_edges_in_parts(spark):
    passage = rows.prose(1, 12)
    texts = [*rows.EDGES, passage.upper() + "!", "before " + passage.replace(" ", ", ") + " after", rows.prose(2, 30)]
    items = [(1, passage), (2, passage), (None, "same same"), (3, None), (4, ""), (5, "a")]
    benchmark = rows.table(spark, items, "item_id bigint, text string")
    docs = rows.documents(spark, texts)
    one = decontaminate.contamination(docs, benchmark).orderBy("doc_id").collect()
    assert [r.contaminated for r in one] == [False] * 3 + [True] + [False] * 3 + [True] * 2 + [False] + [True] * 2 + [False]
    assert (one[-2].n_words, one[-2].n_hit, one[-2].n_items) == (14, 12, 2)
    assert one[-2].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert (one[7].n_hit, one[7].n_items) == (2, 0)
    flags = [f.name for f in docs.schema.fields if f.name != "n_words"]
    marked = decontaminate.mark_benchmark_words(docs, benchmark, part_bytes=40).orderBy("doc_id").collect()
    whole = decontaminate.mark_benchmark_words(docs, benchmark).orderBy("doc_id").collect()
    assert marked == whole and set(flags) <= set(marked[0].asDict())
    nothing = rows.table(spark, [], "item_id bigint, text string")
    assert decontaminate.contamination(docs, nothing).filter("contaminated").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "</turn>", "<|turn|>", "### User:", "x", "<", "/turn>", "#"]), max_size=10))
def test_escaping_is_reversible_and_hides_control_strings(parts):
    text = "".join(parts)
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(control in hidden for control in chat.CONTROL)


def test_chat_reads_back(spark):
    said = [
        (1, 1, "assistant", "a</turn>b"), (1, 0, "user", "\\### Assistant: hi"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (2, 0, None, "x"), (None, 5, "user", "y" * 30_000), (None, 6, "assistant", "<|body|>"),
    ]
    turns = rows.table(spark, said, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_turns(turns, VOCABULARY, PATTERN)
    got = {r.conv_id: r for r in chat.read_back(formatted, VOCABULARY, PATTERN).collect()}
    assert set(got) == {1, 2, None}
    want = "user\n\\### Assistant: hi\nassistant\na</turn>b\nassistant\n\nassistant\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (4, 9)
    assert got[1].loss_sha256 == hashlib.sha256(b"a</turn>b").hexdigest()
    assert got[None].loss_chars == 8 and got[2].loss_chars == 0
    assert chat.read_back(formatted.limit(0), VOCABULARY, PATTERN).count() == 0
