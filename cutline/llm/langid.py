"""Language identification: the family first, then one-versus-one linear support vector machines inside it."""

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 4096            # hashed character n-grams
SAMPLE_PER_LABEL = 500  # about so many training texts of each language, twice as many at most
UNDETERMINED = "und"
SLOPE = 3.0             # of the logistic curve from margin to score

#: Families by ISO 639-1 code (fixed values); a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr pa gu ne ur sd",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "celtic": "ga cy gd br",
    "malayic": "id ms jv su",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(label: str) -> str:
    return _FAMILY_OF.get(label.lower().replace("_", "-").split("-")[0], f"only {label}")


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: list[str], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """One unit row per text over hashed bigrams and trigrams of its lower-cased letters, words bounded; and whether it has a letter."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    row = np.repeat(np.arange(len(texts)), [c.size + 2 for c in codes])
    gap = np.zeros(1, "<u4")
    code = np.concatenate([x for c in codes for x in (gap, c, gap)]) if codes else gap[:0]
    code = np.where(_is_letter()[code], code, 0).astype(np.uint64)
    has = np.bincount(row[code > 0], minlength=len(texts)) > 0
    # runs of other characters count as one boundary
    kept = code > 0
    kept[1:] |= (code[:-1] > 0) | (row[1:] != row[:-1])
    kept[:1] = True
    code, row = code[kept], row[kept].astype(np.uint64)
    counts = np.zeros(len(texts) * slots)
    for n in (2, 3):
        if code.size < n:
            break
        size = code.size - n + 1
        key = np.full(size, n, np.uint64)
        for j in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + code[j:size + j]
        key ^= key >> np.uint64(29)
        slot = (key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(slots)
        inside = (row[:size] == row[n - 1:]) & (code[1:size + 1] > 0 if n == 3 else (code[:size] > 0) | (code[1:size + 1] > 0))
        counts += np.bincount((row[:size] * np.uint64(slots) + slot)[inside].astype(np.int64), minlength=counts.size)
    x = np.sqrt(counts.reshape(len(texts), slots)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x, has


def train_svm(x: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (the bias last) of a linear support vector machine by dual coordinate descent on the squared hinge loss."""
    weights, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    row = np.ones(x.shape[1] + 1)  # one row at a time in double precision; the matrix stays as small as it came
    share = np.where(sign > 0, (sign < 0).sum(), (sign > 0).sum()) / len(sign) * 2 * cost  # both classes weigh the same
    damp = 1 / (2 * share)
    curve = np.array([1.0 + (r.astype(np.float64) ** 2).sum() for r in x]) + damp
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            row[:-1] = x[i]
            slope = sign[i] * (row @ weights) - 1 + damp[i] * alpha[i]
            new = max(alpha[i] - slope / curve[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * sign[i] * row
                alpha[i] = new
    return weights


@dataclass
class Tournament:
    """One-versus-one machines over some names: the most wins, then the widest margins, then the first name."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @staticmethod
    def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> "Tournament":
        pairs = list(combinations(range(len(names)), 2))
        own = []
        for a, b in pairs:
            pick = (y == names[a]) | (y == names[b])
            own.append(train_svm(x[pick], np.where(y[pick] == names[a], 1.0, -1.0)))
        return Tournament(names, pairs, np.array(own).astype(np.float32) if own else None)

    def play(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its score, the product of its matches' logistic margins."""
        return self.matches(x)[:2]

    def matches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``play``, and the winner's smallest margin in any of its matches (infinite without a match)."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x)), np.full(len(x), np.inf)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, width = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        log_score, least = np.zeros((len(x), len(self.names))), np.full((len(x), len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, k].astype(np.float64)
            wins[:, a] += m >= 0
            wins[:, b] += m < 0
            width[:, a] += m
            width[:, b] -= m
            log_score[:, a] -= np.logaddexp(0, -SLOPE * m)
            log_score[:, b] -= np.logaddexp(0, SLOPE * m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = np.argmax(wins + np.tanh(width / len(self.names)) / 4, axis=1)
        at = np.arange(len(x))
        return best, np.exp(log_score[at, best]), least[at, best]


@dataclass
class LanguageModel:
    families: Tournament
    inside: dict[str, Tournament]
    slots: int = SLOTS
    floor: float = -np.inf  # the smallest margin of a clear text, see ``clear_margin``

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and the winner's smallest match margin of each text."""
        if not self.families.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        return self.judge_rows(*features([t or "" for t in texts], self.slots))

    def judge_rows(self, x: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        labels, scores, least = [UNDETERMINED] * len(x), np.zeros(len(x)), np.full(len(x), -np.inf)
        family, sure, outer = self.families.matches(x)
        for f, name in enumerate(self.families.names):
            at = np.nonzero((family == f) & has)[0]
            if at.size:
                own = self.inside[name]
                best, inner, margin = own.matches(x[at])
                scores[at] = sure[at] * inner
                least[at] = np.minimum(outer[at], margin)
                for i, k in zip(at.tolist(), best.tolist()):
                    labels[i] = own.names[k]
        return labels, scores, least


def groups_of(texts: list, size: int = 1 << 19, most: int = 256):
    """Slices of the list with about ``size`` characters and at most ``most`` texts each; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size or i - at + 1 >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def fit_rows(x: np.ndarray, y: np.ndarray, slots: int = SLOTS) -> LanguageModel:
    names = sorted(set(y.tolist()))
    home = np.array([family_of(label) for label in y.tolist()], object)
    families = sorted(set(home.tolist()))
    inside = {f: Tournament.fit([n for n in names if family_of(n) == f], x[home == f], y[home == f]) for f in families}
    return LanguageModel(Tournament.fit(families, x, home), inside, slots)


def clear_margin(x: np.ndarray, y: np.ndarray, slots: int = SLOTS, parts: int = 5) -> float:
    """A winner's match margin well below that of all rightly recognised rows, each judged by machines that have not seen it: by half
    of the smallest. A margin of one match means the same with any number of languages, unlike a product over matches."""
    part, clear = np.zeros(len(y), np.int64), []
    for label in set(y.tolist()):
        part[y == label] = np.arange((y == label).sum()) % parts
    for k in range(parts):
        seen, held = part != k, part == k
        if held.any() and seen.any():
            labels, _, least = fit_rows(x[seen], y[seen], slots).judge_rows(x[held], np.ones(held.sum(), bool))
            clear.append(least[np.array(labels, object) == y[held]])
    least = np.concatenate(clear).min(initial=np.inf) if clear else np.inf
    return float(least - abs(least) / 2) if np.isfinite(least) else -np.inf


def fit_languages(docs: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL, slots: int = SLOTS, calibrate: bool = False) -> LanguageModel:
    """Fit on a bounded sample of the rows whose lang is not null: about ``sample_per_label`` texts of every language, chosen by
    the hash of doc_id. Tasks turn the texts into vectors, so the driver meets only vectors of fixed size. ``calibrate`` also sets the floor of clear texts."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("doc_id", F.lit("languages")).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(Tournament([]), {}, slots)
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, sample_per_label / n)))])
    drawn = rows.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share[F.col("lang")])
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= 2 * sample_per_label).drop("k", "h")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_of(texts):
                x, has = features(texts[a:b], slots)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x[has].astype(np.float16)], pa.binary()),
                                                  batch.column(1).slice(a, b - a).filter(pa.array(has))], names=["x", "lang"])

    table = drawn.mapInArrow(run, "x binary, lang string").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    y = np.array(table.column("lang").to_pylist(), object)
    x = np.array([np.frombuffer(v, np.float16) for v in table.column("x").to_pylist()]).astype(np.float32).reshape(len(y), slots)
    model = fit_rows(x, y, slots)
    if calibrate:
        model.floor = clear_margin(x, y, slots)
    return model


def identify(docs: DataFrame, model: LanguageModel, reject: bool = False) -> DataFrame:
    """The rows with lang_pred and lang_score (0 to 1) added from the whole text alone.

    With ``reject`` a text whose winner has a match margin under the model's floor is ``und`` as well; its score stays.
    ``und`` with score 0 where the text is null or has no letter, or the model has learned nothing. Columns of these two names are
    replaced; all others, repeated rows and nulls pass unchanged. An empty table gives an empty result.
    """
    rows = docs.drop("lang_pred", "lang_score")
    at = rows.columns.index("text")
    names = [*rows.columns, "lang_pred", "lang_score"]

    def run(batches):
        for batch in batches:
            texts, labels, scores = batch.column(at).to_pylist(), [], []
            for a, b in groups_of(texts):
                own = model.judge(texts[a:b])
                labels += [UNDETERMINED if reject and m < model.floor else label for label, m in zip(own[0], own[2].tolist())]
                scores.append(own[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=names)

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("lang_score")).schema)
