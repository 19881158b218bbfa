"""Language of texts and of the spans of mixed texts.

Model: byte n-grams (two to four bytes, word ends marked) of lower-cased words, counted per
language over ``SAMPLE`` labelled documents (the first by a hash of the id; repeated ids add rows),
folded into ``FEATURES`` cells; and the letters of each language by script.

Prediction: a word's script (by code point ranges) narrows the candidates to the languages that
write at least ``SCRIPT_SHARE`` of their letters in it (all, where no language does). Viterbi
over the word scores with a penalty for each switch labels every word; runs of one label are
spans. Words without a letter take the label of their surroundings. A document's language is
the one with most letters, its score the share of letters with that label.

Null texts, and texts without a letter, are ``und`` with score 0, as is everything when there
is no labelled document. Repeated rows are predicted each. Extra columns are ignored. No rows give
no rows. Ties go to the language first in alphabetical order.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailoom.llm.common import arrow_batch, slices, staged

SAMPLE = 2000
FEATURES = 1 << 15
SCRIPT_SHARE = 0.01
SWITCH = 12.0
FOLDS = 5
PLACES = 1 << 40
UNKNOWN = "und"
CACHE = 300_000
SLICE = 8 << 20
OUT = -1e4

# First and last code point of script blocks
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FA1F, "han"),
]
SCRIPT_NAMES = sorted({name for _, _, name in SCRIPTS}) + ["other"]
_STARTS = np.array([a for a, _, _ in SCRIPTS])
_ENDS = np.array([b for _, b, _ in SCRIPTS])
_IDS = np.array([SCRIPT_NAMES.index(name) for _, _, name in SCRIPTS])


def script_of(letter: str) -> int:
    at = int(np.searchsorted(_STARTS, ord(letter), "right")) - 1
    return int(_IDS[at]) if at >= 0 and ord(letter) <= _ENDS[at] else len(SCRIPT_NAMES) - 1


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of all words and the word of each."""
    raw = np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode(), np.uint8).astype(np.uint32)
    word = np.cumsum(raw == 0) - 1
    cells, owner = [], []
    for n in (2, 3, 4):
        if len(raw) < n:
            continue
        count = len(raw) - n + 1
        h = np.zeros(count, np.uint32)
        inside = np.ones(count, bool)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ (raw[i:i + count] + np.uint32(n))
            if 0 < i < n - 1:
                inside &= raw[i:i + count] != 0
        # an n-gram may begin with the mark before a word, or end with the one after it
        h = (h ^ (h >> np.uint32(15))) % np.uint32(FEATURES)
        cells.append(h[inside])
        owner.append(word[:count][inside])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    real = owner[order] < len(words)
    return cells[order][real].astype(np.int64), owner[order][real]


def clean(word: str) -> str:
    return letters(word).lower()


class Model:
    """Word scores of each language; bounded by languages times FEATURES."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32)
        writes = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        self.candidates = np.where(writes.any(axis=1)[:, None], writes, True)
        self.rows: dict[str, int] = {}
        self.scores, self.sizes = [], []

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word, language) and letters of every word."""
        wanted = set(words)
        if len(self.rows) + len(wanted) > CACHE:
            self.rows, self.scores, self.sizes = {}, [], []
        new = sorted(wanted - self.rows.keys())
        if new:
            plain = [clean(w) for w in new]
            scores = np.zeros((len(new), len(self.languages)), np.float32)
            at = [i for i, w in enumerate(plain) if w]
            if at:
                cells, owner = word_features([plain[i] for i in at])
                begin = np.searchsorted(owner, np.arange(len(at)))
                scores[at] = np.add.reduceat(self.logs[cells], begin, axis=0)
                scores[at] += np.where(self.candidates[[script_of(plain[i][0]) for i in at]], 0, OUT)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.scores.append(scores)
            self.sizes.append(np.array([len(w) for w in plain], np.int64))
        if len(self.scores) > 1:
            self.scores, self.sizes = [np.concatenate(self.scores)], [np.concatenate(self.sizes)]
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.scores[0][rows], self.sizes[0][rows]

    def label(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Viterbi label of every word, and its letters; all texts advance side by side."""
        counts = np.array([len(t) for t in texts])
        if not counts.sum():
            return [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        scores, sizes = self.look_up([w for t in texts for w in t])
        begin = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        lanes_at = np.searchsorted(-counts[order], -np.arange(counts.max()), "left")  # texts longer than each step
        stay = np.zeros((len(scores), len(self.languages)), bool)
        jump = np.zeros(len(scores), np.int16)
        value = np.zeros((len(texts), len(self.languages)), np.float32)
        first = begin[order]
        for step, lanes in enumerate(lanes_at):
            at = first[:lanes] + step
            v = value[:lanes]
            best = v.argmax(axis=1)
            top = v[np.arange(lanes), best] - SWITCH
            stay[at], jump[at] = v >= top[:, None], best
            v = np.maximum(v, top[:, None]) + scores[at]
            value[:lanes] = v - v.max(axis=1, keepdims=True)
        labels = np.zeros(len(scores), np.int64)
        now = np.zeros(len(texts), np.int64)
        lanes = 0
        for step in range(len(lanes_at) - 1, -1, -1):
            more = lanes_at[step]
            now[lanes:more] = value[lanes:more].argmax(axis=1)
            lanes = more
            at = first[:lanes] + step
            labels[at] = now[:lanes]
            now[:lanes] = np.where(stay[at, now[:lanes]], now[:lanes], jump[at])
        return np.split(labels, begin[1:]), np.split(sizes, begin[1:])


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the labelled documents outside the held-out fold."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place")
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", place)
    sizes = staged(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    # a threshold a little above the sample leaves few rows a language to number
    few = labelled.select("lang", "place").join(sizes, "lang").filter(F.col("place").cast("double") * F.col("n") <= 1.5 * (sample + 50) * PLACES)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    cuts = staged(few.withColumn("turn", turn).filter(F.col("turn") <= sample).groupBy("lang").agg(F.max("place").alias("cut")))
    rows = labelled.join(cuts, "lang").filter("place <= cut").select("lang", "text")
    ddl = "lang string, cell int, n bigint"

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = [w for w in map(clean, text.split()) if w]
                if not words:
                    continue
                total = totals.setdefault(lang, np.zeros(FEATURES + len(SCRIPT_NAMES), np.int64))
                total[:FEATURES] += np.bincount(word_features(words)[0], minlength=FEATURES)
                for w in words:
                    total[FEATURES + script_of(w[0])] += len(w)
        for lang, total in totals.items():
            cells = np.flatnonzero(total)
            yield arrow_batch(ddl, [lang] * len(cells), cells, total[cells])

    counted = rows.mapInArrow(run, ddl).groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    table = np.zeros((FEATURES + len(SCRIPT_NAMES), max(len(languages), 1)), np.float64)
    for r in counted:
        table[r["cell"], languages.index(r["lang"])] = r["n"]
    return Model(languages, table[:FEATURES], table[FEATURES:])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the spans (label, words) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id bigint, held_out boolean, lang_pred string, score double, spans string"

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts, SLICE):
                words = [t.decode().split() if t and model.languages else [] for t in texts[begin:end]]
                out = []
                for labels, sizes in zip(*model.label(words)):
                    weight = np.bincount(labels, weights=sizes, minlength=len(model.languages)) if len(labels) else np.zeros(1)
                    if not weight.sum():
                        out.append((UNKNOWN, 0.0, ""))
                        continue
                    best = int(weight.argmax())
                    cuts = np.flatnonzero(np.diff(labels)) + 1
                    runs = zip(labels[np.concatenate([[0], cuts])], np.diff(np.concatenate([[0], cuts, [len(labels)]])))
                    out.append((model.languages[best], float(weight[best] / weight.sum()), " ".join(f"{model.languages[i]}:{n}" for i, n in runs)))
                yield arrow_batch(ddl, batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), *zip(*out))

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(held_out(), F.lit(False)), F.col("text").cast("binary"))
    return rows.mapInArrow(run, ddl)


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).drop("spans")
