"""Problem 6: broken prompt and response pairs.

Each answer is held against its prompt and against refusal templates by token alignment: shingle
containment first, then the longest common subsequence. A refusal template is a row of slots (regret,
who speaks, inability, task, what is asked); the words of each sentence of the whole answer are
labelled with slots and their labels aligned with the templates, so that wordings unseen count, too.
What is neither a copy nor a refusal is judged by its language (character n-gram profiles, fitted here
on a bounded sample of answers, prompts and labelled texts; Vietnamese with and without accents are
two profiles of one language) and by its end: fewer sentences than the prompt, a last sentence far
shorter than the prompt's, or an end that a completion model trained here does not take for one. The
model is an averaged perceptron over the last words of a sentence, fitted on a bounded sample of
terminated answers and random cuts of them; everything else looks at every row.

One narrow pass over the rows after the dedup of repeated records; no join, no shuffle of texts
beyond that dedup.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from papyrion.llm.fold import latin, visible
from papyrion.llm.spam import FUNCTION_WORDS
from papyrion.session import sample_by_hash

#: Words of each slot of a refusal, accents folded (fixed values): regret, speaker, inability, task, what is asked.
SLOTS = {
    "R": "xin loi; thanh that xin loi; rat tiec; tiec rang; mong ban thong cam; sorry; apologies; apologize; unfortunately; afraid; regret; leider; tut mir leid; bedaure; entschuldigung; desole; malheureusement; regrette; pardon; lo siento; lamento; lamentablemente; 抱歉; 对不起; 很遗憾",
    "S": "toi; minh; em; he thong; mo hinh ngon ngu; tro ly; i; we; me; my; language model; an ai; assistant; ich; wir; sprachmodell; ki; mir; je; j; nous; moi; modele de langage; yo; me; modelo de lenguaje; 我; 我们",
    "N": "khong the; khong duoc phep; khong co du; khong du; khong lam duoc; khong dich duoc; khong ho tro; khong giup duoc; khong tra loi duoc; chua the; tu choi; xin phep khong; khong co kha nang; ngoai kha nang; vuot qua kha nang; ngoai pham vi; can t; cannot; can not; could not; couldn t; unable; not able; not allowed; not permitted; won t; will not; must decline; decline; refuse; impossible; beyond; outside; kann nicht; kann das nicht; kann ich nicht; kann ich leider nicht; kann leider nicht; nicht moglich; nicht in der lage; lehne ab; ablehnen; darf nicht; darf ich nicht; ne peux pas; ne peut pas; ne pouvons pas; pas en mesure; pas autorise; refuse; dois refuser; hors de; no puedo; no podemos; no es posible; no me es posible; 无法; 不能; 不可以",
    "T": "dich; xu ly; tra loi; ho tro; giup; giup do; thuc hien; dap ung; cung cap; lam; translate; translation; process; processed; answer; help; assist; assistance; produce; comply; provide; fulfil; fulfill; complete; respond; do; ubersetzen; ubersetzung; bearbeiten; beantworten; helfen; machen; erfullen; ausfuhren; unterstutzen; traduire; traduction; repondre; aider; traiter; faire; satisfaire; traducir; responder; ayudar; procesar; hacer; 翻译; 回答; 帮助; 处理",
    "O": "doan nay; yeu cau nay; yeu cau; noi dung nay; viec nay; van ban nay; van ban duoc gui; cau hoi nay; cau nay; dieu nay; thong tin; this; that; it; request; content; material; text; passage; diesen; diese; dieses; das; anfrage; inhalt; ce texte; cette demande; ce contenu; cela; demande; ce passage; esto; este texto; esta solicitud; solicitud; 这个; 此; 请求; 内容",
}
#: What a refusal says, slot by slot (fixed values).
TEMPLATES = ("RSNTO", "SNTO", "RNTO", "RSNT", "ONT", "ONTS", "ONST", "ONS", "SNO", "SONT", "SOTN", "NSOT", "SRNT", "ORSN", "RSNO")
#: Labels before an answer are at most this long.
LABEL = re.compile(r"^\W*[^\W\d_][^:\n]{0,24}:\s+")
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_CJK = re.compile("[\u3040-ヿ㐀-鿿가-\ud7af]")
_NAME = re.compile(r"[^\W\d_]*[A-Z0-9ÀÁÉÏÖÜ][\w]*(?:-\w+)*")
_WORDY = re.compile(r"(?<![\w-])[a-zà-ÿ]{2,}(?![\w])")
_CUT_MARK = re.compile(r"(?:…|\.\.\.+|[(\[{,;:–—-])\s*[.]?$")
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*$")

#: Rows on which the models are fitted, and labelled texts for the profiles.
SAMPLE_ROWS, SAMPLE_TEXTS = 4000, 1500
EPOCHS = 4


@lru_cache(100_000)
def bare_word(word: str) -> str:
    return bare(word)


def bare(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in t if not unicodedata.combining(c)).replace("đ", "d")


def _phrases() -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Phrases by their first word, the longest first, with their slot."""
    out: dict[str, list[tuple[tuple[str, ...], str]]] = defaultdict(list)
    for slot, words in SLOTS.items():
        for p in words.split(";"):
            t = tuple(p.split())
            out[t[0]].append((t, slot))
    return {w: sorted(x, key=lambda y: -len(y[0])) for w, x in out.items()}


_PHRASES = _phrases()
#: A refusal says nothing without one of these.
_INABILITY = frozenset(w for p in SLOTS["N"].split(";") for w in p.split()[:1]) | {"kann", "konnen", "darf", "peux", "peut"}


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def is_copy(src: list[str], ans: list[str]) -> bool:
    """Nine tenths of the answer's tokens run along the source."""
    if not src or not ans:
        return False
    own = set(src)
    if sum(x in own for x in ans) < 0.85 * len(ans):
        return False
    k = min(5, len(src), len(ans))
    shingles = {tuple(src[i : i + k]) for i in range(len(src) - k + 1)}
    held = sum(tuple(ans[i : i + k]) in shingles for i in range(len(ans) - k + 1))
    if held < 0.5 * (len(ans) - k + 1):
        return False
    return lcs(src, ans) >= 0.9 * max(len(ans), min(len(src), 0.5 * len(src)))


#: Inability in two parts, the second at most five words after the first (fixed values).
GAPPED = {"nicht": frozenset({"kann", "konnen", "konnte", "darf", "durfen"}), "pas": frozenset({"peux", "peut", "pouvons", "puis"}), "duoc": frozenset({"khong", "chua"})}


def slots(words: list[str]) -> tuple[str, int]:
    """(slot of each phrase in order, words that belong to one)."""
    out, i, held = [], 0, 0
    while i < len(words):
        if (first := GAPPED.get(words[i])) and first & set(words[max(0, i - 5) : i]) and "N" not in out[-2:]:
            out.append("N")
            held += 2
            i += 1
            continue
        for t, slot in _PHRASES.get(words[i], ()):
            if tuple(words[i : i + len(t)]) == t:
                out.append(slot)
                held += len(t)
                i += len(t)
                break
        else:
            i += 1
    return "".join(out), held


def refuses(words: list[str]) -> bool:
    """Whether a sentence's slots run along a refusal template, and its other words are few."""
    if not _INABILITY & set(words):
        return False
    row, held = slots(words)
    if "N" not in row or not ("T" in row or "O" in row):
        return False
    best = max(lcs(list(t), list(row)) / len(t) for t in TEMPLATES)
    return best == 1 and (held >= 0.4 * len(words) or row[0] == "R" and held >= 0.3 * len(words))


def is_refusal(text: str) -> bool:
    """Sentences that refuse make up two fifths of the answer's words, or open it and are all but a fifth."""
    if not _CJK.search(text) and not _INABILITY & set(map(bare_word, _TOKEN.findall(text.lower()))):
        return False
    total = said = 0
    first = None
    for s in _SENTENCE.split(text.strip()):
        w = [bare_word(x) for x in _TOKEN.findall(s.lower())]
        if _CJK.search(s):
            w = [c for x in w for c in _chinese(x)]
        if not w:
            continue
        no = refuses(w)
        first = no if first is None else first
        total += len(w)
        said += no * len(w)
    return total > 0 and (said >= 0.4 * total or bool(first) and said >= 0.2 * total)


def _chinese(word: str) -> list[str]:
    """A run of Chinese characters cut at the phrases that the slots know."""
    return re.findall("|".join(sorted(_HAN, key=len, reverse=True)) + r"|\w", word)


_HAN = [p for words in SLOTS.values() for p in map(str.strip, words.split(";")) if _CJK.search(p)]


class Profiles:
    """Log probabilities of character trigrams by language; a word's are kept."""

    def __init__(self, table: dict[str, tuple[float, ...]], languages: tuple[str, ...], unseen: tuple[float, ...]):
        self.table, self.languages, self.unseen = table, languages, unseen
        self.memo: dict[str, tuple[float, ...]] = {}

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Profiles:
        counts = {}
        for lang, of in texts.items():
            words = Counter(w for t in of for w in set(plain_words(t)))  # no text outweighs the others
            n: Counter = Counter()
            for w, k in words.items():
                for g in trigrams(w):
                    n[g] += k
            if n:
                counts[lang] = n
        every = sorted({g for n in counts.values() for g in n})
        size = len(every) + 1
        logs = {x: math.log(sum(n.values()) + 0.5 * size) for x, n in counts.items()}
        table = {g: tuple(math.log(n.get(g, 0) + 0.5) - logs[x] for x, n in counts.items()) for g in every}
        return cls(table, tuple(counts), tuple(math.log(0.5) - logs[x] for x in counts))

    def of(self, word: str) -> tuple[float, ...]:
        if (v := self.memo.get(word)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            v = self.memo[word] = tuple(map(sum, zip(*(self.table.get(g, self.unseen) for g in trigrams(word)))))
        return v

    def likeliest(self, words: list[str]) -> str | None:
        """The language in which the words are likeliest; None without words or profiles."""
        if not words or not self.languages:
            return None
        totals = [sum(x) for x in zip(*map(self.of, words))]
        return self.languages[totals.index(max(totals))]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)] or [w]


def plain_words(text: str) -> list[str]:
    """Words in small letters, names left out; all words where there are no others."""
    words = [w for w in _TOKEN.findall(text) if w.isalpha()]
    return [w.lower() for w in words if w.islower() or not w[1:].islower()] or [w.lower() for w in words]


#: The language the answers should be in, and its profile without accents.
WANTED, WANTED_BARE = "vi", "vi-bare"


def foreign(text: str, profiles: Profiles) -> bool:
    """Mostly in a language other than Vietnamese."""
    letters = [c for c in text if c.isalpha()] if not text.isascii() else []
    if sum(not _LATIN.match(c) for c in letters) * 3 > len(letters) > 0:
        return True
    best = profiles.likeliest(plain_words(text))
    return best is not None and best not in (WANTED, WANTED_BARE)


_LATIN = re.compile("[a-zA-ZÀ-ɏḀ-ỿ]")


def shape(word: str) -> str:
    """A word as the model sees it: names and numbers by class."""
    if not word.isalpha() and any(c.isdigit() for c in word):
        return "0"
    if word[:1].isupper():
        return "N"
    return bare_word(word)


def features(sentence: str) -> list[str]:
    w = [shape(x) for x in sentence.split()]
    w = [x.strip("\"'“”().,;:") or x for x in w]
    n = len(w)
    out = ["b", f"l{min(n, 12)}"]
    out += [f"{k}|" + " ".join(w[-k:]) for k in (1, 2, 3, 4, 5) if n >= k]
    out += [f"s{' '.join(w[:2])}|{n // 3}", f"s{' '.join(w[:2])}|{' '.join(w[-1:])}"]
    return out


def train_completion(answers: list[str], seed: int = 7) -> dict[str, float]:
    """Weights of an averaged perceptron: positive for the end of a complete sentence."""
    rng = random.Random(seed)
    data: list[tuple[list[str], int]] = []
    for a in answers:
        for s in _SENTENCE.split(a.strip()):
            s = s.strip()
            if len(s) < 15 or not _END.search(s):
                continue
            s = s.rstrip(".!?。")
            data.append((features(s), 1))
            for _ in range(2):
                at = rng.randint(int(0.15 * len(s)), int(0.88 * len(s)))
                if rng.random() < 0.5:
                    at = s.rfind(" ", 0, at + 1)
                if at > 3:
                    data.append((features(s[:at].rstrip()), -1))
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for f, y in data:
            step += 1
            if y * sum([w.get(x, 0.0) for x in f]) <= 0:
                for x in f:
                    w[x] = w.get(x, 0.0) + y
                    total[x] = total.get(x, 0.0) + y * step
    return {x: v - total[x] / max(step, 1) for x, v in w.items()}


def completeness(weights: dict[str, float], sentence: str) -> float:
    return sum([weights.get(x, 0.0) for x in features(sentence)])


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text.strip())) if _TOKEN.search(s)]


def truncated(src: str, ans: str, weights: dict[str, float], aligned: bool) -> bool:
    """Stops well before its end. ``aligned``: the answer translates the prompt sentence by sentence."""
    a = ans.strip()
    open_end = not _END.search(a)
    marked = bool(_CUT_MARK.search(a)) and not _CUT_MARK.search(src.strip())
    if marked:
        return True
    src_ends = bool(_END.search(src.strip()))
    if aligned:
        s, t = sentences(src), sentences(a)
        if not s or not t:
            return False
        ratio = len(a) / max(len(src.strip()), 1)
        if len(t) < len(s) and ratio < 0.8:
            return True
        if open_end:
            if len(t) < len(s):
                return src_ends
            last = len(t[-1]) / max(len(s[-1]), 1)
            if last < 0.55:
                return True
            if not src_ends:
                return last < 0.62
            return last < 0.8 and completeness(weights, t[-1]) < 0
        return False
    if not open_end:
        return False
    t = sentences(a)
    return bool(t) and completeness(weights, t[-1]) < 0


def carries(src: str, ans: str) -> bool:
    """Whether an answer holds half of the prompt's names and numbers: what it says is the prompt's."""
    own = {w for w in _TOKEN.findall(src) if any(c.isdigit() for c in w) or any(c.isupper() for c in w[1:])} | set(re.findall(r"(?<=[a-z,] )[A-Z][^\W\d_]+", src))
    return bool(own) and 2 * len(own & set(_TOKEN.findall(ans))) >= len(own)


def only_names(src: str) -> bool:
    """No words but names, numbers and symbols."""
    rest = _NAME.sub(" ", src)
    return not any(w not in ("et", "al", "vs") for w in _WORDY.findall(rest))


def defect(src: str, ans: str, weights: dict[str, float], aligned: bool, profiles: Profiles | None = None) -> str | None:
    shown = visible(ans)
    if not any(c.isalnum() for c in shown):
        return "empty"
    source = latin(src)
    text = latin(shown)
    s, a = _TOKEN.findall(source.lower()), _TOKEN.findall(text.lower())
    if only_names(source) and (a == s or is_copy(s, a)):
        return None
    if is_copy(s, a) or ((m := LABEL.match(text)) and is_copy(s, _TOKEN.findall(text[m.end() :].lower()))):
        return "copy"
    if is_refusal(text) and not carries(source, text):
        return "refusal"
    if foreign(shown, profiles or fit_profiles([])):
        return "lang"
    if not s:
        return "truncated" if _CUT_MARK.search(shown.strip()) else None
    return "truncated" if truncated(source, shown, weights, aligned) else None


def fit_profiles(sample: list[tuple[str | None, str | None]], labelled: list[tuple[str, str]] = ()) -> Profiles:
    """Profiles from (prompt, answer) rows, prompts being English, and from (language, text) rows.

    The function words of the usual languages are part of theirs, so that none is without a profile.
    """
    texts: dict[str, list[str]] = defaultdict(list, {k: [v] for k, v in FUNCTION_WORDS.items()})
    for src, ans in sample:
        texts["en"].append(latin(src or ""))
        texts[WANTED].append(visible(ans or ""))
    for lang, text in labelled:
        texts[lang.strip().lower()].append(visible(text))
    texts[WANTED_BARE] = [" ".join(map(bare_word, plain_words(t))) for t in texts[WANTED]]
    return Profiles.fit({k: v for k, v in texts.items() if any(v)})


def broken_answers(rows: DataFrame, key: str = "key", src: str = "src", fields: dict[str, bool] | None = None, *, texts: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(tm_key, field, defect): one row for each broken answer.

    ``fields``: answer columns, True where the answer translates the prompt. A null answer was never
    requested and gives nothing; a null or empty prompt leaves the checks that need none. Records
    that come in several rows count once. The completion model and the profiles of English prompts and
    Vietnamese answers are fitted on at most ``sample_rows`` rows (those with the smallest hash of their
    key). ``texts`` (id, lang, text): labelled texts for the profiles of other languages, of which at most
    ``SAMPLE_TEXTS`` are taken; labels may be wrong now and then.
    """
    fields = fields if fields is not None else {"vi": True, "plain": False}
    names = list(fields)
    kept = rows.select(rows[key].alias("k"), rows[src].alias("s"), *(rows[f].alias(f"a{i}") for i, f in enumerate(names))).filter("k is not null")
    sample = sample_by_hash(kept, "k", sample_rows).collect()
    weights = {f: train_completion([r[f"a{i}"] for r in sample if r[f"a{i}"]]) for i, f in enumerate(names)}
    labelled: list[tuple[str, str]] = []
    if texts is not None:
        t = texts.select("id", "lang", "text").filter("id is not null and trim(lang) <> '' and trim(text) <> ''")
        labelled = [(r.lang, r.text) for r in sample_by_hash(t, "id", SAMPLE_TEXTS).collect()]
    profiles = fit_profiles([(r.s, r[f"a{i}"]) for r in sample for i in range(len(names)) if r[f"a{i}"]], labelled)
    shared = rows.sparkSession.sparkContext.broadcast((weights, profiles.table, profiles.languages, profiles.unseen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, *made = shared.value
        profiles = Profiles(*made)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for i, f in enumerate(names):
                w, aligned = models[f], fields[f]
                for k, s, a in zip(cols[0], cols[1], cols[2 + i]):
                    if a is not None and (d := defect(s or "", a, w, aligned, profiles)):
                        out.append((k, f, d))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1]), pa.array(c[2])], names=["tm_key", "field", "defect"])

    return kept.distinct().mapInArrow(run, f"tm_key {dict(kept.dtypes)['k']}, field string, defect string").distinct()
