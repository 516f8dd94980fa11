"""Parts that need no Spark: coders, automata, models, masks, permutations, parsers."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notelake.llm import decontaminate, embed_dedup, html_extract, html_train, minhash, pii, quality
from notelake.llm.bytesets import shingle_hashes, words_by_text
from notelake.llm.html_blocks import blocks
from notelake.llm.html_model import BiLstm
from notelake.llm.lexicon import Entry, LexiconAutomaton
from notelake.llm.rans import Coder, Frequencies
from notelake.llm.token_output import _BYTE_LETTERS, ChunkEncoder, read_tokenizer


@pytest.mark.parametrize("n", [0, 1, 255, 1000, 70_001])
def test_rans_round_trip_and_segments(n):
    symbols = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49407).astype(np.int64)
    coder = Coder(Frequencies.of_counts(np.bincount(symbols, minlength=49408)))
    block = coder.encode(symbols, lanes=64, segment=4096)
    assert (coder.decode(block) == symbols).all()
    for k in range(len(block.positions)):
        part = coder.decode_segment(block, k)
        assert (part == symbols[k * block.interval * block.lanes :][: len(part)]).all()


def test_chunk_encoder_equals_whole_tokenizer():
    source = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    whole, own = Tokenizer.from_str(source), ChunkEncoder(source)
    for text in ("Hello, world! don't DON'T", "Ünï Ç'est l’été <|endoftext|>x \x1c y ½ ² İ ŉ ß ſ × 漢字　q\x0bw é", "", " \n\t ", "a" * 5000, "x_1 $$$ 3.14%"):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_chunk_encoder_holds_one_words_tokens():
    """The tokens of a word are gone when the next word is encoded; only its ids stay."""
    own, alive, most = ChunkEncoder(read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))), 0, 0
    model = own.model

    class Token:
        def __init__(self, number):
            nonlocal alive, most
            self.id, alive = number, alive + 1
            most = max(most, alive)

        def __del__(self):
            nonlocal alive
            alive -= 1

    class Model:
        def tokenize(self, word):
            return [Token(t.id) for t in model.tokenize(word)]

    own.model = Model()
    words = [f"word{'xyz'[k % 3] * (k // 3)}é" for k in range(60)]
    longest = max(len(model.tokenize(w.encode().decode("latin-1").translate(_BYTE_LETTERS))) for w in words)
    text = " ".join(words)
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert 0 < most <= longest + 1 and alive == 0


def test_word_and_shingle_hashes():
    a, b, c, d = words_by_text([b"The cat  SAT", b"the\tCAT\nsat", None, b"x"])
    assert (a == b).all() and len(c) == 0 and len(shingle_hashes(d, 2)) == 1 and len(shingle_hashes(a, 2)) == 2


def test_posterior_bounds_keep_true_links():
    params = minhash.MinHashParams()
    ends = minhash.least_matches(params)
    assert [h for h, _ in ends][-1] == params.hashes and all(m < 0.8 * h for h, m in ends)


def test_masks_leave_no_window_unhit():
    placed = lambda n: [frozenset(o + i for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(n - len(m) + 1)]
    for n, k in ((15, 3), (13, 2)):
        seeds = placed(n)
        assert all(any(not s & set(c) for s in seeds) for c in itertools.combinations(range(n), k))


def test_decontamination_against_brute_force():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(15, 40))] for _ in range(30)]
    probe = decontaminate.Probe([(k, decontaminate.words_of(" ".join(w))) for k, w in enumerate(items)], decontaminate.DecontaminationParams())
    for trial in range(60):
        k = r.randrange(30)
        copy = list(items[k])
        for at in r.sample(range(len(copy)), len(copy) // 8):
            copy[at] = "zz"
        text = [r.choice(vocabulary) for _ in range(200)]
        at = r.randrange(200)
        found = probe.find(" ".join(text[:at] + copy + text[at:]).upper() + "!")
        assert k in {f[0] for f in found}, trial
        assert not probe.find(" ".join(text))


def test_decontamination_of_short_items():
    params = decontaminate.DecontaminationParams()
    for n in range(4, 14):
        item = [f"w{k}" for k in range(n)]
        probe = decontaminate.Probe([(7, decontaminate.words_of(" ".join(item)))], params)
        for k in range(4):
            for changed in itertools.combinations(range(n), k):
                copy = ["zz" if at in changed else w for at, w in enumerate(item)]
                kept = [at for at in range(n) if at not in changed]
                found = probe.find(" ".join(["x", "y", *copy, "x"]))
                whole = 5 * len(kept) >= 4 * n
                assert found == ([(7, n, 2 + kept[0], kept[0], kept[-1] + 1 - kept[0], len(kept))] if whole else []), (n, changed)
        assert not probe.find(" ".join(item[1:])) and not probe.find(" ".join(item[:-1]))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    r = random.Random(2)
    lexicon = ["idiot", "worthless", "scum", "disgusting", "moron"]
    edits = {"idiot": 1, "worthless": 2, "scum": 0, "disgusting": 2, "moron": 1}
    automaton = LexiconAutomaton([Entry(w, e) for w, e in edits.items()])
    for _ in range(4000):
        word = list(r.choice(lexicon))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word))
            word[at : at + r.randint(0, 1)] = r.choice(["", "a", "t", "s"])
            word = word or ["q"]
        text = "".join(word)
        want = any(text[:1] == w[0] and (text == w or (distance(text, w) <= e and min(distance(text[k:], w[1:]) for k in (1,)) <= e)) for w, e in edits.items())
        assert bool(automaton.match(text)) == want, text


def test_feistel_is_a_permutation_and_keeps_formats():
    for size in (1, 2, 10, 97, 1000):
        network = pii.Feistel(b"k", "t", size)
        images = [network.encrypt(x) for x in range(size)]
        assert sorted(images) == list(range(size)) and [network.decrypt(y) for y in images] == list(range(size))
    p = pii.Pseudonymizer(b"key")
    for kind, value in (("card", "4539 1488 0343 6467"), ("ip", "10.0.0.1"), ("iso", "2024-02-29"), ("dmy", "01.12.1999"), ("ssn", "123-45-6789"), ("phone", "+1 (980) 555-6268"), ("email", "Ann.b9@mail.example.com"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")):
        new = pii.pseudonym(p, kind, value)
        assert new != value and [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind in ("ip", "secret")
        assert pii.pseudonym(p, kind, new, undo=True) == value
        assert pii._valid(kind, new)


def test_pii_is_found_and_linked():
    p = pii.Pseudonymizer(b"key")
    text = "Call +1 (980) 555-6268 or mail a.34@mail0.example.com; card 4463724487863232, not 4463724487863233; 173.33.203.46 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" on 2024-02-30, 2024-02-28."
    new, spans = pii.redact(text, p)
    kinds = [k for k, _, _ in spans]
    assert kinds.count("phone") == kinds.count("email") == kinds.count("ip") == kinds.count("secret") == kinds.count("iso") == 1
    assert "2024-02-30" in new and "555-6268" not in new and "a.34@" not in new
    again, _ = pii.redact("x a.34@mail0.example.com", p)
    assert again.split()[1] in new
    assert pii.redact("", p) == ("", []) and pii.redact("plain", p) == ("plain", [])


def test_pii_windows_lose_no_value(monkeypatch):
    r = random.Random(8)
    texts = ["1 " + "a " * 46 + "password: correcthorsebattery", "token" + " " * 300 + "=" + "\n" * 300 + "'correcthorsebattery' x", "password: " + "a" * 500 + " 1"]
    texts += ["1 " + "a" * (k % 3) + "a " * (k // 2) + " " * (k % 2) + "password: correcthorsebattery" for k in range(200)]
    parts = ["a ", "word ", "1", "=", " : ", " ", "\n" * 90, "token", "secret =", "correcthorsebattery", "4463724487863232", "x" * 70, "a.34@mail0.example.com", " 173.33.203.46", "(980) 555-6268 ", "2024-02-28"]
    texts += ["".join(r.choices(parts, k=r.randint(1, 60))) for _ in range(2000)]
    found = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "_windows", lambda text: iter([(0, len(text))]))
    assert found == [pii.find(t) for t in texts]
    assert all(f and f[-1][2] == "secret" for f in found[:203])


def test_capitals_are_counted_in_the_whole_text():
    at = quality.FEATURES.index("capitals")
    assert quality.features("lower case words " * 300 + "SHOUTED JUNK " * 450)[at] == 0.5
    assert quality.features("lower case words " * 300)[at] == 0 and quality.features("\U0001d400\U0001d401 bold")[at] == 0.5


def test_html_blocks_and_labels():
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href='/'>Menu</a></nav><div class='ad'>Buy &amp; go now please.</div><article><h1>Head\n line</h1><p><b>One &amp; two words here.<br><p>Three &lt; four.</p></article><section class='comments'><p>Nice post, thanks a lot.</p></section><footer>&copy; x</footer>"
    found = blocks(page)
    assert [b.text for b in found] == ["T", "Menu", "Buy & go now please.", "Head line", "One & two words here.", "Three < four.", "Nice post, thanks a lot.", "© x"]
    (mine,) = html_extract.label(BiLstm.load(), [found])
    assert [b.text for b, m in zip(found, mine, strict=True) if m] == ["Head line", "One & two words here.", "Three < four."]
    assert blocks("") == [] and blocks("<p") is not None and blocks("<<<>>&#0;") is not None


def test_labeller_on_pages_it_was_not_trained_on():
    examples = html_train.examples(120, seed=99)
    labels = html_extract.label(BiLstm.load(), [b for b, _ in examples])
    right = sum(int((m == np.array(y, bool)).sum()) for m, (_, y) in zip(labels, examples, strict=True) if y)
    assert right / sum(len(y) for _, y in examples) > 0.985


def test_labeller_gradients():
    model = BiLstm.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    from notelake.llm.html_model import batch_of, features

    examples = html_train.examples(3, seed=9)
    dense, paths = batch_of([features(b) for b, _ in examples])
    y = np.zeros(dense.shape[:2])
    for k, (_, labels) in enumerate(examples):
        y[k, : len(labels)] = labels
    _, grads = model.gradients(dense, paths, y)
    for name in ("out", "fhidden", "bpath", "fdense"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        kept, ends = model.w[name][at], []
        for step in (1e-3, -1e-3):
            model.w[name][at] = kept + step
            ends.append(model.gradients(dense, paths, y)[0])
        model.w[name][at] = kept
        assert abs((ends[0] - ends[1]) / 2e-3 - grads[name][at]) < 1e-4 + 0.01 * abs(grads[name][at])


def test_multi_index_recall():
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 32))
    near = x[:600] + 0.02 * r.standard_normal((600, 32))
    x = np.concatenate([x, near])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embed_dedup.fit_index(x[:2000], 200_000, embed_dedup.MultiIndexParams())
    assert len(index.first) > 4 and embed_dedup.brute_force_recall(x, index, 0.98) >= 0.99
    cells = index.cells(x[:50], 9)
    d1, d2 = index.distances(x[:50])
    total = (d1[:, :, None] + d2[:, None, :]).reshape(50, -1)
    assert np.allclose(np.sort(total, axis=1)[:, :9], np.take_along_axis(total, cells, 1))
