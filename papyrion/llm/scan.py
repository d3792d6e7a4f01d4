"""Problem 7: noise in text from scanned pages.

Furniture (running headers, page numbers) is found by line or block from its form and from its place:
first or last on its page, repeated over pages but for its digits, the title it repeats, a printed
number that goes with the page's, and the sentence or word that it interrupts. What remains is edited
by an averaged-perceptron character editor, trained here: for each character it predicts an output
that is a keep, a replacement, a deletion or an insertion, and for a hyphen at a line end whether the
lines join. Its training pairs are mined from the corpus itself: rare tokens with the one frequent
word within two edits (a bounded sample), and frequent words broken at line ends. A correction
counts only if the result is a word of the corpus.

The vocabulary holds the words of at least ``SHARE`` of all texts, so at most (mean words of a
text / SHARE) entries at any corpus size; that bound is what makes its broadcast safe. The editor
decodes along its prefixes, so that a name is given up after a few letters. A word that is a misreading
of a far more frequent one is refused. Rarer words stay in a distributed table: they meet the unknown
words in an equi-join on a shape key, in which characters that the editor takes for each other are one,
and the editor verifies what meets. Lines that repeat over the pages of a document are counted in the
JVM from short lines only.

Everything is matched on a folded text and applied to the original: letters of other scripts stay as
they are where nothing was misread. The texts themselves are never shuffled for ``scan_noise``; for
``repaired`` only records with a rarer correction or a repeated line are joined and repaired again.
"""

from __future__ import annotations

import difflib
import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.fold import latin
from papyrion.session import cut

#: Share of texts, and number of texts, in which a vocabulary word stands at least.
SHARE, LEAST = 1e-3, 3
#: Rare tokens from which training pairs are mined, and words broken for the line-join examples.
MINED, BROKEN = 3000, 1500
EPOCHS = 4
#: Times that a word stands more often than a vocabulary word that is refused as its misreading.
FAR_MORE = 50
#: Times that a word outside the vocabulary stands more often than its misreadings; their shortest length.
RARE_MORE, RARE_LENGTH = 3, 5

_TOKEN = re.compile(r"[!@|$]?[^\W_]+(?:[!@|$'’-][^\W_]+)*")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_BREAK = re.compile(r"([^\s]*[^\W_])-[ \t]*\n[ \t]*([^\s]+)")
_ODD = re.compile(r"[!@|$0-9]")
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{0,3}))"
_PAGE = re.compile(rf"^\W{{0,3}}(?:(?:page|seite|trang|p\.)\s*\d{{1,5}}(?:\s*(?:of|/|von|trên)\s*\d{{1,5}})?|\d{{1,5}}\s*/\s*\d{{1,5}}|[-–—\[(]?\s*\d{{1,5}}\s*[-–—\])]?|(?=[ivx]){_ROMAN})\W{{0,2}}$", re.I)
_NOT_PAGE = re.compile(r"[.,;:%]\s*$|\d[.,]\d")
_NUMBER_SIDE = re.compile(r"^(?P<a>\d{1,5})[\s|·–-]+(?=\D)|(?:(?<=[^\W\d_])|(?<=\.))[\s|·–-]+(?P<b>\d{1,5})$")
_AUTHORS = re.compile(r"^(?:preprint\W+under\s+review\W+)?[^\W\d_][^\W\d_'’-]+\s+(?:et\s+al|and\s+co-?authors|and\s+others)\W*$", re.I)
_PREPRINT = re.compile(r"^preprint\W+under\s+review", re.I)
_PROSE_KINDS = frozenset({"para", "abstract", "summary", "meta", "", None})
_SENTENCE_END = (".", "!", "?", ",", ";", ":")


def restore(out: str, folded: str, original: str) -> str:
    """The repaired text with the original characters of every token that the repair left alone."""
    if folded == original:
        return out
    was = [(f, t) for t in original.split() if (f := latin(t))]
    pieces = re.split(r"(\s+)", out)
    at = [i for i, x in enumerate(pieces) if x and not x.isspace()]
    match = difflib.SequenceMatcher(None, [f for f, _ in was], [pieces[i] for i in at], autojunk=False)
    for m in match.get_matching_blocks():
        for k in range(m.size):
            pieces[at[m.b + k]] = was[m.a + k][1]
    return "".join(pieces)


def masked(line: str) -> str:
    """A line as it repeats over pages: lower case, single blanks, no digits."""
    return re.sub(r"\d+", "#", " ".join(line.lower().split()))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _close(a: str, b: str) -> bool:
    """Equal but for one character."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def repeats_title(words: list[str], title: list[str]) -> bool:
    """Three quarters of the words run along the title, from some place of it on."""
    if len(words) < 3 or not title or 3 * len(set(words) & set(title)) < len(words):
        return False
    for start in range(max(1, len(title) - 1)):
        run = title[start : start + len(words)]
        if len(run) < min(len(words), 3):
            break
        if sum(_close(a, b) for a, b in zip(words, run)) >= 0.75 * len(words):
            return True
    return False


def page_number(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 24 and _PAGE.match(s) is not None and not _NOT_PAGE.search(s)


def header(line: str, title: list[str]) -> tuple[bool, bool]:
    """(is a running header by its form, holds a page number)."""
    s = " ".join(line.split())
    if len(s) < 4 or len(s) > 160:
        return False, False
    m = _NUMBER_SIDE.search(s) if s[0].isdigit() or s[-1].isdigit() else None
    core = (s[: m.start()] + s[m.end() :] if m else s).strip(" |·–-")
    caps = core.isupper()
    if _AUTHORS.match(core) or _PREPRINT.match(core):
        return True, bool(m)
    if core.endswith((".", "!", "?", ",")) and not caps:
        return False, False
    words = _words(core)
    if "·" in core or "|" in core:
        part = _words(re.split(r"[·|]", core)[-1])
        if repeats_title(part, title) or (part and title[: len(part)] == part):
            return True, bool(m)
    if repeats_title(words, title):
        return True, bool(m)
    if caps and len(words) >= 2 and sum(c.isalpha() for c in core) >= 10 and not any(c.isdigit() for c in core):
        return True, bool(m)
    return False, False


def wordy(line: str) -> bool:
    """Short, mostly letters, and not the end of a sentence: what a running header may be made of."""
    s = line.strip()
    return 3 < len(s) <= 100 and 2 * sum(c.isalpha() for c in s) >= len(s) and not s.endswith(_SENTENCE_END) and (s[0].isupper() or s[0].isdigit())


class Editor:
    """Averaged perceptron over characters; an output string for each, and joins at line ends."""

    def __init__(self, vocab: dict[str, int], weights: dict[str, dict[str, float]] | None = None, outputs: dict[str, list[str]] | None = None, shapes: list[tuple[str, str]] | None = None, kept: frozenset[str] = frozenset()):
        self.vocab = vocab
        self.weights = weights or {}
        self.outputs = outputs or {}
        #: Runs of characters taken for others, the most frequent first.
        self.shapes = shapes or []
        self.memo: dict[str, str | None] = {}
        words = {w.lower() for w in vocab if w and w[0] != "-" and (w.islower() or w == w.capitalize())}
        self.prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
        self.ends = words
        #: Of a sign or digit in a word of which nothing was learned any letter may be meant.
        self.letters = tuple(sorted({c for w in words for c in w if c.isalpha()}))
        #: Words as they may be printed without being unknown.
        every = {w.lower() for w in vocab} | kept
        self.surfaces = frozenset(vocab) | every | {w.capitalize() for w in every} | {w.upper() for w in every}
        #: Words outside the vocabulary that are too frequent for the misreading they look like.
        self.kept = kept
        #: Printed tokens looked at before.
        self.looked: dict[str, tuple[str | None, tuple[str, ...]]] = {}
        #: Corrections to words outside the vocabulary, of the record at hand.
        self.rare: dict[str, str] = {}

    @staticmethod
    def features(w: str, i: int) -> tuple[str, ...]:
        p = f"  {w}  "
        i += 2
        return (p[i], "<" + p[i - 1 : i + 1], ">" + p[i : i + 2], "=" + p[i - 1 : i + 2], "»" + p[i : i + 3], "«" + p[i - 2 : i + 1])

    def join_features(self, left: str, right: str) -> tuple[str, ...]:
        """Of a hyphen between two lines: what the vocabulary knows of the parts."""
        v = self.vocab
        tail, head = left.rsplit("-", 1)[-1], right.split("-", 1)[0]
        joined = (tail + head).lower() in v or (left + right).lower() in v
        whole = f"{left}-{right}".lower() in v or f"{tail}-{head}".lower() in v or (left[:1].isupper() and ("-" + head) in v)
        return ("J", f"j{joined}", f"w{whole}", f"l{tail.lower() in v}{head.lower() in v}", f"jw{joined}{whole}", f"c{head[:1].isupper() or not head[:1].isalpha()}")

    def score(self, feats: tuple[str, ...], out: str) -> float:
        s = 0.0
        for f in feats:
            if (w := self.weights.get(f)) is not None:
                s += w.get(out, 0.0)
        return s

    def state(self) -> tuple:
        """What another Editor is made of; what the broadcasts carry."""
        return self.vocab, self.weights, self.outputs, self.shapes, self.kept

    def train(self, pairs: list[tuple[str, str]], breaks: list[tuple[str, str, bool]], seed: int = 11) -> None:
        rng = random.Random(seed)
        data: list[tuple[tuple[str, ...], str, list[str]]] = []
        outs: dict[str, Counter] = defaultdict(Counter)
        runs: Counter = Counter()
        aligned = [(a, edits(a, b)) for a, b in pairs]
        for a, e in aligned:
            at = [i for i, (c, o) in enumerate(zip(a, e)) if c != o]
            for i in at:
                if i - 1 not in at:
                    end = next(j for j in range(i, len(a) + 1) if j not in at)
                    runs[a[i:end], "".join(e[i:end])] += 1
        self.shapes = [r for r, n in runs.most_common() if n >= 2 and r[1] and len(r[0]) <= 2 and len(r[1]) <= 2]
        for a, e in aligned:
            for c, o in zip(a, e):
                outs[c][o] += 1
        self.outputs = {c: [o for o, n in k.most_common(8) if n >= 2 and o != c and not (len(o) > 1 and c in o)] for c, k in outs.items()}
        for a, e in aligned:
            for i, (c, o) in enumerate(zip(a, e)):
                choice = [c, *self.outputs.get(c, [])]
                if o in choice and len(choice) > 1:
                    data.append((self.features(a, i), o, choice))
        for left, right, join in breaks:
            data.append((self.join_features(left, right), "J" if join else "K", ["J", "K"]))
        total: dict[str, dict[str, float]] = defaultdict(dict)
        w: dict[str, dict[str, float]] = defaultdict(dict)
        self.weights, step = w, 0
        for _ in range(EPOCHS):
            rng.shuffle(data)
            for f, y, choice in data:
                step += 1
                best = max(choice, key=lambda o: self.score(f, o))
                if best != y:
                    for x in f:
                        for o, d in ((y, 1.0), (best, -1.0)):
                            w[x][o] = w[x].get(o, 0.0) + d
                            total[x][o] = total[x].get(o, 0.0) + d * step
        self.weights = {x: {o: v - total[x][o] / max(step, 1) for o, v in k.items()} for x, k in w.items()}

    def joins(self, left: str, right: str) -> bool:
        f = self.join_features(left, right)
        s = self.score(f, "J") - self.score(f, "K")
        return s > 0 or (s == 0 and "jTrue" in f and "wFalse" in f)  # nothing learned: the vocabulary decides

    def correct(self, word: str) -> str | None:
        """The word, of the vocabulary or a rarer one, that a lower-case token was misread from; None where it is none."""
        if word in self.kept:
            return None
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = self.known(word, self.readings(word))
        return self.memo[word] or self.rare.get(word)

    def known(self, word: str, readings: list[str]) -> str | None:
        """The first reading of a token that is in the vocabulary."""
        for t in readings:
            if (f := self.vocab.get(t) or self.vocab.get(t.capitalize())) and misread(word, t) and (len(word) > 3 or _ODD.search(word) or f >= self.vocab.get("", 0) * 0.01):
                return t
        return None

    def readings(self, word: str) -> list[str]:
        """The vocabulary words that a lower-case token may be a misreading of, the likeliest first.

        The outputs of the characters are followed along the prefixes of the vocabulary, with at most
        five edits; what comes to the end of a word is scored by the perceptron.
        """
        states: dict[str, tuple[int, tuple[tuple[int, str], ...]]] = {"": (0, ())}
        for i, c in enumerate(word):
            new: dict[str, tuple[int, tuple[tuple[int, str], ...]]] = {}
            options = self.outputs.get(c, ()) or (self.letters if _ODD.match(c) else ())
            for t, (n, made) in states.items():
                for o in (c, *options):
                    k = n + (o != c)
                    x = t + o
                    if k <= 5 and (x in self.prefixes or not x) and (x not in new or new[x][0] > k):
                        new[x] = k, made if o == c else (*made, (i, o))
            states = new
            if not states:
                return []
        ends = [(t, made) for t, (n, made) in states.items() if n and t in self.ends and t != word]
        if len(ends) < 2:
            return [t for t, _ in ends]
        return [t for _, t in sorted(((sum(self.gain(word, i, o) for i, o in made), t) for t, made in ends), reverse=True)]

    def gain(self, word: str, i: int, out: str) -> float:
        """How much likelier the output is than to keep the character."""
        f = self.features(word, i)
        return self.score(f, out) - self.score(f, word[i])

    def verified(self, word: str, target: str) -> bool:
        """Whether each change from a token to a word is an output the editor knows."""
        return misread(word, target) and all(c == o or o in self.outputs.get(c, ()) for c, o in zip(word, edits(word, target)))

    def unsign(self, word: str) -> str | None:
        """A name with one sign or digit among its letters, with the likeliest letter in its place."""
        i = next(k for k, c in enumerate(word) if _ODD.match(c))
        options = [o for o in self.outputs.get(word[i].lower(), ()) if o.isalpha()]
        if not options:
            return None
        low = word.lower()
        return word[:i] + max(options, key=lambda o: (self.gain(low, i, o), o)) + word[i + 1 :]

    def shape_key(self) -> Callable[[str], str]:
        """A function under which a word and its misreadings come out alike, as far as the runs learned say.

        Single characters taken for each other are one class; a run of two and a character are one,
        too, unless that would go in a circle.
        """
        up: dict[str, str] = {}
        wide: dict[str, str] = {}

        def top(c: str) -> str:
            while c in up:
                c = up[c]
            return c

        def reach(c: str) -> set[str]:
            c = top(c)
            return {c}.union(*(reach(x) for x in wide.get(c, "")))

        for a, b in self.shapes:
            if len(a) == len(b) == 1:
                x, y = top(a), top(b)
                if x != y and not (x in wide and y in wide) and x not in reach(y) and y not in reach(x):
                    if y in wide:
                        x, y = y, x
                    up[y] = x
            elif {len(a), len(b)} == {1, 2}:
                two, one = (a, b) if len(a) == 2 else (b, a)
                x = top(one)
                if x not in wide and all(x not in reach(c) for c in two):
                    wide[x] = two

        @lru_cache(4096)
        def key(c: str) -> str:
            c = top(c)
            return "".join(map(key, wide[c])) if c in wide else c

        return lambda word: "".join(map(key, word))

    def refused(self) -> set[str]:
        """Vocabulary words that are a misreading of a far more frequent one."""
        out = set()
        for w, n in self.vocab.items():
            if len(w) >= 5 and w.isalpha() and w.islower():
                if any(self.vocab.get(t, 0) >= FAR_MORE * n and _distance(w, t) <= 2 and misread(w, t) for t in self.readings(w)):
                    out.add(w)
        return out


def edits(a: str, b: str) -> list[str]:
    """For each character of a, what it becomes in b, along a cheapest alignment."""
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out = [""] * n
    i, j = n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out[i - 1] = b[j - 1] + out[i - 1]
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
            out[max(i - 1, 0)] = b[j] + out[max(i - 1, 0)]
    for i in range(n - 1):  # what comes before a replaced character belongs to it
        if len(out[i]) > 1 and out[i][0] == a[i] and out[i + 1] not in ("", a[i + 1]):
            out[i], out[i + 1] = a[i], out[i][1:] + out[i + 1]
    return out


def misread(a: str, b: str) -> bool:
    """Whether a may be b misread: shapes are replaced, letters alone do not come or go."""
    e = edits(a, b)
    for i, (c, o) in enumerate(zip(a, e)):
        if len(o) > 1 and c in o:
            return False
        if o == "" and not any(0 <= j < len(a) and e[j] not in ("", a[j]) for j in (i - 1, i + 1)):
            return False
    return True


def _deletes(w: str) -> set[str]:
    one = {w[:i] + w[i + 1 :] for i in range(len(w))}
    return {w} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}


def _distance(a: str, b: str, most: int = 2) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def fit_editor(vocab: dict[str, int], rare: list[str], seed: int = 11) -> Editor:
    """An editor trained on rare tokens and their only near vocabulary word, and on broken words."""
    rng = random.Random(seed)
    plain = [w for w in vocab if len(w) >= 5 and w.isalpha() and w.islower()]
    index: dict[str, list[str]] = defaultdict(list)
    for w in plain:
        for x in _deletes(w):
            index[x].append(w)
    pairs = []
    for r in rare:
        if len(r) < 5 or r in vocab:
            continue
        near = {w for x in _deletes(r) for w in index.get(x, ())}
        by = sorted((_distance(r, w), w) for w in near)
        by = [x for x in by if x[0] <= 2]
        if by and (len(by) == 1 or by[0][0] < by[1][0]) and misread(r, by[0][1]):
            pairs.append((r, by[0][1]))
    # letters that do not come as noise elsewhere are left to context: clean words as examples
    clean = [(w, w) for w in rng.sample(sorted(plain), min(len(plain), max(500, 2 * len(pairs))))]
    breaks = []
    for w in rng.sample(sorted(plain), min(len(plain), BROKEN)):
        at = rng.randint(2, len(w) - 2)
        breaks.append((w[:at], w[at:], True))
    compounds = sorted(w for w in vocab if "-" in w[1:] and w[0] != "-")
    for w in compounds:
        a, _, b = w.rpartition("-")
        breaks.extend([(a, b, False)] * max(1, BROKEN // (4 * len(compounds))))
    for suffix in sorted(w[1:] for w in vocab if w.startswith("-")):
        breaks.append(("Xenolith", suffix, False))
    e = Editor(vocab)
    e.train(pairs + clean, breaks)
    return e


_BROKEN = re.compile(r"\S+-[ \t]*\n[ \t]*\S+")
_HYPHEN_BLANKS = re.compile(r"-[ \t]+\n")


def _breaks(text: str) -> bool:
    """Whether a hyphen ends a line; far cheaper than to look for the words around it."""
    return "-\n" in text or _HYPHEN_BLANKS.search(text) is not None


def text_words(text: str) -> set[str]:
    """The printed tokens of a text; parts of words broken at line ends are left out."""
    t = latin(text)
    if _breaks(t):
        t = _BROKEN.sub(" ", t)
    return set(_TOKEN.findall(t))


def listed(tokens: dict[str, int]) -> Counter:
    """Numbers of printed tokens as numbers of words: marks at their sides go, ends of names with a hyphen count, too."""
    out: Counter = Counter()
    for w, n in tokens.items():
        if w[:1] in "!|$" and not _ODD.search(w[1:]):
            w = w.strip("!@|$")
        out[w] += n
        if "-" in w and w[:1].isupper():
            out["-" + w.rsplit("-", 1)[1]] += n
    return out


def find_words(text: str, editor: Editor, unknown: set[str] | None = None) -> tuple[str, bool]:
    """The text with misread words corrected, and whether there were any.

    Only the text's distinct tokens outside the vocabulary are looked at; most texts have none to
    correct. ``unknown`` takes the words that nothing is known of.
    """
    fixes = {}
    for w in set(_TOKEN.findall(text)) - editor.surfaces:
        new, strange = (None if editor.rare else editor.looked.get(w)) or _look(w, editor)
        if new:
            fixes[w] = new
        if unknown is not None and strange:
            unknown.update(strange)
    if not fixes:
        return text, False
    return _TOKEN.sub(lambda m: fixes.get(m[0], m[0]), text), True


def _look(w: str, editor: Editor) -> tuple[str | None, tuple[str, ...]]:
    """What a printed token is corrected to, and the words in it that nothing is known of; kept where no record's own corrections count."""
    strange: set[str] = set()
    out = _fix_token(w, w.lower(), editor, strange), tuple(strange)
    if not editor.rare:
        if len(editor.looked) > 400_000:
            editor.looked.clear()
        editor.looked[w] = out
    return out


def _fix_token(w: str, low: str, editor: Editor, unknown: set[str] | None) -> str | None:
    if low in editor.surfaces or w.isdigit() or not any(map(str.isalpha, w)):
        return None
    if "-" not in w[1:]:
        return _fix_word(w, editor, unknown)
    if (whole := editor.correct(low)) is not None:
        return whole.capitalize() if w[0].isupper() else whole
    if unknown is not None:
        unknown.add(low)
    parts = w.split("-")
    new = [p if i and "-" + p in editor.vocab else _fix_word(p, editor, unknown) or p for i, p in enumerate(parts)]
    return "-".join(new) if new != parts else None


def _fix_word(w: str, editor: Editor, unknown: set[str] | None) -> str | None:
    low = w.lower()
    if len(w) < 3 or low in editor.surfaces or not any(map(str.isalpha, w)):
        return None
    if sum(map(str.isdigit, w)) * 2 >= len(w):
        return None
    odd = _ODD.search(w) is not None
    if not odd and w[0].isupper() and not w[1:].islower():
        return None
    c = editor.correct(low)
    if c:
        return c.capitalize() if w[0].isupper() else c
    if odd and _ONE_SIGN.fullmatch(w) and (name := editor.unsign(w)):
        return name
    if unknown is not None and len(low) >= RARE_LENGTH:
        unknown.add(low)
    return None


_ONE_SIGN = re.compile(r"[^\W\d_]*[^\W\d_A-Z][!@|$0159][a-z][^\W\d_]*")
_LAST_WORD = re.compile(r"([^\W\d_]+)-\s*$")
_FIRST_WORD = re.compile(r"\s*([^\W\d_]+)")


def interrupts(before: str, line: str, after: str, vocab: dict[str, int]) -> bool:
    """Whether a line stands within a broken word: the lines around it make one, it doesn't go on with it."""
    left, right = _LAST_WORD.search(before), _FIRST_WORD.match(after)
    if not left or not right or not right[1][0].islower() or len(line) > 100 or not line.strip() or line.strip()[0].islower():
        return False
    own = _FIRST_WORD.match(line)
    return (left[1] + right[1]).lower() in vocab and not (own and (left[1] + own[1]).lower() in vocab)


def repair_lines(text: str, title: list[str], kind: str | None, editor: Editor, repeated: frozenset[str] = frozenset(), unknown: set[str] | None = None, shown: bool = True) -> tuple[str, set[str]]:
    """One text as continuous paragraphs, and the kinds of noise it held.

    ``repeated``: masked lines that stand on other pages of the same document, too. Where the text is not
    to be ``shown``, it is empty.
    """
    noise: set[str] = set()
    t = latin(text)
    lines = t.split("\n") if "\n" in t else [t]
    if len(lines) > 1 and kind in _PROSE_KINDS:
        kept = []
        for i, s in enumerate(lines):
            if page_number(s):
                noise.add("pageno")
                continue
            is_header, numbered = header(s, title)
            if not is_header and (repeated and masked(s) in repeated or kept and kept[-1].endswith("-") and i + 1 < len(lines) and interrupts(kept[-1], s, lines[i + 1], editor.vocab)):
                is_header, numbered = wordy(s), bool(_NUMBER_SIDE.search(" ".join(s.split())))
            if is_header:
                noise.add("header")
                if numbered:
                    noise.add("pageno")
                if find_words(s, editor, unknown)[1]:
                    noise.add("ocr")
                continue
            kept.append(s)
        lines = kept or lines
    body = "\n".join(lines)

    def join(m: re.Match) -> str:
        left, right = m[1], m[2]
        tail = re.search(r"[^\W_][^\s]*$", left)
        a = re.sub(r"^[^\w]+", "", left) if tail else left
        b = re.match(r"[!@|$]?[^\W_]*(?:[!@|$][^\W_]+)*(?:-[^\W_]+)*", right)[0]
        if not b:
            return m[0]
        glued = (a.rsplit("-", 1)[-1] + b.split("-", 1)[0]).lower()
        known = editor.joins(a, b) or (glued not in editor.vocab and editor.correct(glued) is not None and f"{a}-{b}".lower() not in editor.vocab)
        if known:
            noise.add("hyphen")
            return left + right
        return left + "-" + right

    if len(lines) > 1 and _breaks(body):
        prev = None
        while prev != body:  # a word may run over more than two lines
            prev = body
            body = _BREAK.sub(join, body)
    if kind in _PROSE_KINDS or kind in ("caption", "heading", "title", "figcap"):
        body, hit = find_words(body, editor, unknown)
        if hit:
            noise.add("ocr")
    if not shown:
        return "", noise
    if kind in _PROSE_KINDS and "\n" in body:
        body = re.sub(r"[ \t]*\n[ \t]*(?!\n)", " ", re.sub(r"\n{2,}", "\n\n", body)).replace("  ", " ")
    return restore(body.strip(), t, text), noise


_HOP = frozenset({"caption", "equation", "figure", "table", "figcap", "meta"})
_FRONT = frozenset({"para", "heading", "caption"})


def block_furniture(rows: list[tuple[str, str, str, int | None]], words: list[str]) -> dict[int, set[str]]:
    """Noise of the blocks that are furniture, by their number.

    Each short block without a line break is scored by its form, its place on its page (the first and
    last blocks of a page), how many pages it repeats on but for its digits, the distance of its
    number from the page's (running numbers keep it), and whether it interrupts a sentence. Before the
    first paragraph of the first page nothing but a page number counts: a line of authors is none.
    Blocks without a page are judged by form alone.
    """
    text = [latin(t) for _, _, t, _ in rows]
    body_from = next((i for i, (_, k, t, _) in enumerate(rows) if k in _FRONT and len(t) > 25), 0)
    on: dict[object, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        on[r[3]].append(i)
    edge: dict[int, bool] = {}
    for page, at in on.items():
        if page is not None:
            edge |= dict.fromkeys(at, False) | dict.fromkeys(at[:2] + at[-2:], True)
    cand, spread, steps = {}, defaultdict(set), Counter()
    for i, (_, kind, raw, page) in enumerate(rows):
        t = text[i].strip()
        if kind in ("para", "meta", "heading") and t and len(t) <= 160 and "\n" not in t:
            number = kind != "heading" and page_number(t)
            found = re.findall(r"\d{1,5}", t)
            cand[i] = number, found
            if page is not None and edge[i]:
                spread[masked(t)].add(page)
            if number and page is not None and found:
                steps[int(found[0]) - int(page)] += 1
    out: dict[int, set[str]] = {}
    for i, (number, found) in cand.items():
        _, kind, _, page = rows[i]
        t = text[i].strip()
        at_edge = edge.get(i, True)
        if number:
            runs = page is not None and bool(found) and steps[int(found[0]) - int(page)] > 1
            if at_edge or runs:
                out[i] = {"pageno"}
            continue
        form, numbered = header(t, words)
        if form and kind == "heading" and t.isupper() and not (numbered or repeats_title(_words(t), words)):
            form = False  # a heading in capitals
        pages = len(spread[masked(t)]) if page is not None else 0
        if kind == "heading":
            pages = 0  # headings may come again
        before = next((x for x in reversed(range(i)) if rows[x][1] == "para" and x not in out), None)
        after = next((x for x in range(i + 1, len(rows)) if rows[x][1] == "para" and x not in cand), None)
        broken = before is not None and after is not None and text[before].rstrip()[-1:] not in (".", "!", "?", ":", "") and text[after].lstrip()[:1].islower()
        score = 2.0 * form + 2.0 * (pages > 1 and wordy(t)) + (1.0 if at_edge else -1.0) + 1.0 * (broken and wordy(t)) + 0.5 * (kind == "meta" and page is not None) - 1.0 * (kind == "heading" and not form)
        place = i >= body_from or (kind == "para" and i > 1)
        if place and score >= 2.5:
            out[i] = {"header"} | ({"pageno"} if numbered or _NUMBER_SIDE.search(" ".join(t.split())) else set())
    return out


def repair_blocks(blocks: list[dict], title: str | None, editor: Editor, unknown: dict[str, set[str]] | None = None, shown: bool = True) -> list[tuple[str, str, set[str]]]:
    """(block id, text, noise) of the blocks of one document in reading order; empty text for furniture.

    A word broken at a block's end goes on in the next paragraph, over furniture, captions and
    equations. ``unknown`` takes the words of each block that nothing is known of.
    """
    rows = [(str(b.get("id")), b.get("type") or "para", str(b.get("text") or ""), b.get("page")) for b in blocks if isinstance(b, dict) and b.get("id") is not None]
    rows = [(i, k, t, p if isinstance(p, int) else None) for i, k, t, p in rows]
    named = title or next((t for _, k, t, _ in rows if k == "title"), "")
    words = _words(latin(named))
    furniture = block_furniture(rows, words)
    out: list[list] = []
    for i, (bid, kind, text, _) in enumerate(rows):
        noise = furniture.get(i, set())
        if noise and find_words(latin(text), editor, unknown.setdefault(bid, set()) if unknown is not None and "header" in noise else None)[1] and "header" in noise:
            noise = noise | {"ocr"}
        out.append([bid, kind, "" if noise else text, noise, bool(noise)])
    for i, row in enumerate(out):
        if row[1] != "para" or row[4] or not row[2].rstrip().endswith("-"):
            continue
        m = re.search(r"([^\s]*[^\W\d_])-$", row[2].rstrip())
        if not m:
            continue
        for k in range(i + 1, len(out)):
            nxt = out[k]
            if nxt[4] or nxt[1] in _HOP:
                continue
            h = re.match(r"[!@|$]?[^\W_]+(?:[!@|$][^\W_]+)*", nxt[2].lstrip())
            if nxt[1] == "para" and h and (h[0][:1].islower() or not h[0][:1].isalpha()):
                left = re.sub(r"^\W+", "", m[1]).rsplit("-", 1)[-1]
                glued = latin(left + h[0]).lower()
                fix = glued if glued in editor.vocab else editor.correct(glued)
                if fix or editor.joins(left, h[0]):
                    row[3] = row[3] | {"hyphen"}
                    row[2] = row[2].rstrip()[: -1 - len(left)] + (left + h[0] if not fix or fix == glued else fix)
                    nxt[2] = nxt[2].lstrip()[h.end() :].lstrip()
                    if fix and fix != glued:
                        (row if fix.endswith(h[0].lower()) else nxt)[3] = (row if fix.endswith(h[0].lower()) else nxt)[3] | {"ocr"}
            break
    for row in out:
        if not row[4] and row[1] not in ("equation", "reference"):
            row[2], noise = repair_lines(row[2], words, row[1], editor, unknown=unknown.setdefault(row[0], set()) if unknown is not None else None, shown=shown)
            row[3] = row[3] | noise
    return [(bid, text, noise) for bid, _, text, noise, _ in out]


_OUT = "tbl string, rec_id string, block_id string, text string, noise array<string>, unknown array<string>"


def _texts(tbl: str, text: str) -> list[str]:
    if tbl == "chunk":
        return [text]
    try:
        blocks = json.loads(text)
    except ValueError:
        return []
    return [str(b.get("text") or "") for b in blocks if isinstance(b, dict)] if isinstance(blocks, list) else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        texts = 0
        for tbl, text in zip(*(c.to_pylist() for c in b.columns)):
            for t in _texts(tbl, text):
                if t:
                    texts += 1
                    n.update(text_words(t))
        n = listed(n)
        n[""] = texts
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def _fit(records: DataFrame, share: float = SHARE, mined: int = MINED) -> tuple[Editor, DataFrame]:
    """The editor, and the (word, n) table of all words."""
    counts = cut(records.select("tbl", "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = (counts.filter("word = ''").agg(F.sum("n")).collect()[0][0]) or 0
    # bounded: a text has some dozens of different words, and each entry stands in `share` of all texts
    vocab = {r.word: r.n for r in counts.filter(F.col("n") >= max(LEAST, share * total)).collect()}
    rare = counts.filter((F.col("n") < max(LEAST, share * total)) & F.col("word").rlike(r"^[a-z@!][a-z0-9@!]{4,}$")).orderBy(F.xxhash64("word"), "word").limit(mined)
    vocab, unknown = {w: n for w, n in vocab.items() if w == "" or w[0] == "-" or _WORD.fullmatch(w)}, [r.word for r in rare.collect()]
    editor = fit_editor(vocab, unknown)
    if bad := editor.refused():
        editor = fit_editor({w: n for w, n in vocab.items() if w not in bad}, unknown + sorted(bad))
    return too_frequent(counts, editor, max(LEAST, share * total / FAR_MORE), max(LEAST, share * total)), counts


def too_frequent(counts: DataFrame, editor: Editor, least: float, most: float) -> Editor:
    """The editor with the rarer words that it would take for a misreading, but that stand too often for one.

    A misreading stands at most once for ``FAR_MORE`` of its word. At most (mean words of a text x FAR_MORE / SHARE)
    words can be concerned at any corpus size.
    """
    shared = counts.sparkSession.sparkContext.broadcast(editor.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Editor(*shared.value)
        for b in batches:
            out = []
            for w, n in zip(*(c.to_pylist() for c in b.columns)):
                t = None if w in e.surfaces else e.known(w, e.readings(w))
                if t and e.vocab.get(t, 0) + e.vocab.get(t.capitalize(), 0) < FAR_MORE * n:
                    out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    words = counts.filter(F.col("word").rlike(r"^\p{L}{3,}$")).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.col("n") < most))
    editor.kept = frozenset(r.word for r in words.mapInArrow(run, "word string").collect())
    return Editor(*editor.state())


def fit(records: DataFrame, *, share: float = SHARE, mined: int = MINED) -> Editor:
    """Vocabulary of all texts and the editor trained on it."""
    return _fit(records, share, mined)[0]


def rare_corrections(counts: DataFrame, shared) -> DataFrame:
    """(word, fix): unknown words and the clean word outside the vocabulary that each was misread from.

    Both sides stay distributed and meet on their shape key, one row a word; the editor verifies what
    meets. A target stands in ``LEAST`` texts in small letters (one letter may tell two names apart),
    ``RARE_MORE`` times as many as the unknown word, and is itself no misreading of a vocabulary word.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Editor(*shared.value)
        key = e.shape_key()
        for b in batches:
            rows = []
            for w, n, small in zip(*(c.to_pylist() for c in b.columns)):
                if w in e.vocab or w.capitalize() in e.vocab or e.known(w, e.readings(w)) is not None:
                    continue
                rows.append((key(w), w, n, small if small >= LEAST and w.isalpha() else 0))
            c = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["key", "word", "n", "clean"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Editor(*shared.value)
        for b in batches:
            yield b.filter(pa.array([e.verified(w, t) for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    words = counts.filter(F.col("word").rlike(r"^[\p{L}@!|$][\p{L}0-9@!|$]{4,}$")).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("small"))
    found = cut(words.mapInArrow(keyed, "key string, word string, n long, clean long"))
    clean = found.filter("clean > 0").select("key", F.col("word").alias("to"), F.col("clean").alias("m"))
    met = found.select("key", "word", "n").join(clean, "key").filter((F.col("m") >= RARE_MORE * F.col("n")) & (F.col("word") != F.col("to")))
    sure = met.select("word", "to", "m").mapInArrow(verified, "word string, to string, m long")
    return sure.groupBy("word").agg(F.max_by("to", F.struct("m", "to")).alias("fix"))


def repeated_lines(recs: DataFrame) -> DataFrame:
    """(tbl, rec_id, lines): masked lines of a passage that stand on two or more pages of its document.

    Only short lines that begin with a capital or a digit, don't end a sentence and stand before a
    line in small letters or after an open one are counted, in the JVM; lines go by (document, line), so
    a document of many pages is no hot group.
    """
    line = lambda i: F.trim(F.element_at("lines", i))
    n = F.size("lines")
    shape = lambda i: line(i).rlike(r"^[\p{Lu}\p{N}].{3,99}$") & ~line(i).rlike(r"[.!?,;:]$")
    after = lambda i: F.when(i < n, line(i + 1).rlike(r"^\p{Ll}")).otherwise(i == n)
    before = lambda i: F.when(i > 1, line(i - 1).rlike(r"[\p{Ll}\p{N}-]$")).otherwise(True)
    some = recs.filter("tbl = 'chunk' and doc is not null and page is not null and instr(text, '\\n') > 0").filter(F.coalesce("kind", F.lit("")).isin(*[k for k in _PROSE_KINDS if k is not None]))
    some = some.select("tbl", "rec_id", "doc", "page", F.split("text", "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(shape(i) & after(i) & before(i), F.lit(False)))
    mask = F.regexp_replace(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), r"\d+", "#")
    one = some.select("tbl", "rec_id", "doc", "page", F.explode(F.transform(at, line)).alias("line")).select("tbl", "rec_id", "doc", "page", mask.alias("line")).distinct()
    often = one.groupBy("doc", "line").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b")
    return one.join(often, ["doc", "line"]).groupBy("tbl", "rec_id").agg(F.collect_set("line").alias("lines"))


_MASKED_PAGE = r"^\W{0,3}(?:page|seite|trang|p\.)\s*#(?:\s*(?:of|/|von|trên)\s*#)?\W*$"


def _ready(records: DataFrame) -> DataFrame:
    """The columns a pass needs; ``page`` and ``doc`` are null where the records have none."""
    more = [F.col(c).cast(t) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("doc", "string"))]
    return records.select("tbl", "rec_id", "text", "title", "kind", *more).filter("rec_id is not null and text is not null")


def _pass(recs: DataFrame, shared, with_text: bool) -> DataFrame:
    """One narrow pass over (tbl, rec_id, text, title, kind, lines, fixes): each text's noise and unknown words."""
    held: dict[int, Editor] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in held:
            held[0] = Editor(*shared.value)
        e = held[0]
        for b in batches:
            rows = []
            for tbl, rec, text, title, kind, lines, fixes in zip(*(c.to_pylist() for c in b.columns)):
                e.rare = dict(fixes or ())
                if tbl == "chunk":
                    unknown: set[str] = set()
                    t, noise = repair_lines(text, _words(latin(title or "")), kind, e, frozenset(lines or ()), unknown, with_text)
                    if with_text or noise or unknown:
                        rows.append((tbl, rec, "", t if with_text else None, sorted(noise), list(unknown)))
                    continue
                try:
                    blocks = json.loads(text)
                except ValueError:
                    continue
                if isinstance(blocks, list):
                    by: dict[str, set[str]] = {}
                    rows.extend((tbl, rec, bid, t if with_text else None, sorted(noise), list(by.get(bid, ()))) for bid, t, noise in repair_blocks(blocks, title, e, by, with_text))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c[:4]] + [pa.array(x, pa.list_(pa.string())) for x in c[4:]], names=["tbl", "rec_id", "block_id", "text", "noise", "unknown"])

    return recs.select("tbl", "rec_id", "text", "title", "kind", "lines", "fixes").mapInArrow(run, _OUT)



def _bare(recs: DataFrame) -> DataFrame:
    return recs.withColumn("lines", F.lit(None).cast("array<string>")).withColumn("fixes", F.lit(None).cast("map<string,string>"))


def repaired(records: DataFrame, editor: Editor | None = None) -> DataFrame:
    """(tbl, rec_id, block_id, text, noise) of (tbl, rec_id, text, title, kind[, page, doc]) records.

    ``tbl`` 'chunk': ``text`` is a passage, block_id ''. Else ``text`` is a JSON list of blocks.
    Null texts and ids give no row, JSON that can't be read none, empty texts an empty text without
    noise. Records that come in several rows count once.
    """
    recs = _ready(records).distinct()
    editor, counts = (editor, None) if editor else _fit(recs)
    shared = records.sparkSession.sparkContext.broadcast(editor.state())
    cols = ["tbl", "rec_id", "block_id", "text", "noise"]
    lines = repeated_lines(recs)
    if counts is None:
        return _pass(_bare(recs).drop("lines").join(lines, ["tbl", "rec_id"], "left"), shared, True).select(cols)
    first = cut(_pass(_bare(recs), shared, True))
    words = first.select("tbl", "rec_id", F.explode("unknown").alias("word")).distinct()
    fixes = words.join(rare_corrections(counts, shared), "word").groupBy("tbl", "rec_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("fixes"))
    hints = cut(lines.join(fixes, ["tbl", "rec_id"], "full"))
    again = _pass(recs.join(hints, ["tbl", "rec_id"]), shared, True)
    return first.join(hints, ["tbl", "rec_id"], "left_anti").select(cols).unionByName(again.select(cols))


def scan_noise(records: DataFrame) -> DataFrame:
    """(tbl, rec_id, block_id, noise): each kind of noise found in each text.

    What the pass over the texts can't know of itself is added by joins of words and lines alone:
    corrections to rarer words, and lines repeated over pages.
    """
    recs = _ready(records)
    editor, counts = _fit(recs)
    shared = records.sparkSession.sparkContext.broadcast(editor.state())
    first = cut(_pass(_bare(recs), shared, False))
    keys = ["tbl", "rec_id", "block_id"]
    plainly = first.select(*keys, F.explode("noise").alias("noise"))
    rarer = first.select(*keys, F.explode("unknown").alias("word")).join(rare_corrections(counts, shared), "word").select(*keys, F.lit("ocr").alias("noise"))
    headed = repeated_lines(recs).select("tbl", "rec_id", F.lit("").alias("block_id"), F.explode("lines").alias("line"))
    numbered = F.when(F.col("line").rlike(r"^#|#$"), F.array(F.lit("header"), F.lit("pageno"))).otherwise(F.array(F.lit("header")))
    headed = headed.filter(~F.col("line").rlike(_MASKED_PAGE)).filter(2 * F.length(F.regexp_replace("line", r"[^\p{L}]+", "")) >= F.length("line")).select(*keys, F.explode(numbered).alias("noise"))
    return plainly.unionByName(rarer).unionByName(headed).distinct()
