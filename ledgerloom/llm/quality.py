"""Quality rules: plain counts, and divergence of a text's histograms from those of languages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, arrow_schema, bound_batches, ngram_hashes, or_empty, rows_of, word_hashes

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_CLASSES = 9
#: Words in windows of WINDOW that occur twice are repeated words.
WINDOW = 5
#: The base rules: fewer words, or a larger part in percent of repeated words, fail.
MIN_WORDS, MAX_REPEATED = 10, 20
#: A language has a reference if it has so many words in so many documents, whatever its part of the corpus: fewer make
#: no steady histogram. Its common words have WORD_PART of its words, so there are at most 1 / WORD_PART of them.
LEAST_WORDS, LEAST_DOCS, WORD_PART = 2000, 20, 0.005
#: Texts of fewer words have too rough a histogram for a verdict.
GUARD_CHARS, GUARD_WORDS = 30, 60
#: Divergences (base 2, 0 to 1) beyond which a text is unlike its nearest language.
MAX_CHARS, MAX_COMMON = 0.12, 0.18
#: A text in which its nearest language would have EXPECTED common words or more has this part of them, or is unlike it: its
#: second divergence can't tell, as the common words are a small part of all.
LEAST_COMMON, EXPECTED = 0.1, 12


def _byte_classes() -> np.ndarray:
    """A class for each byte of UTF-8: 0 lower case, 1 upper, 2 digit, 3 blank, 4 line feed, 5 stop or comma, 6 symbol, 7 other ASCII, 8 start of another character; 9 for the rest of one."""
    out = np.full(256, 7, np.intp)
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:'\"()-?", SYMBOLS]):
        for c in chars:
            out[ord(c)] = k
    out[0x80:0xC0], out[0xC0:] = 9, 8
    return out


_CLASS_OF = _byte_classes()


def char_classes(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=_CLASSES + 1)[:_CLASSES]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""
    h = ngram_hashes(word_hashes(words), window)
    if len(h) < 2:
        return 0
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of p from each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0.0), np.where(q > 0, q * np.log2(q / m), 0.0)
    return (a.sum(-1) + b.sum(-1)) / 2


#: kind: _WORD for a word's count, a class of characters, or _DOCS for documents; all but words have a null word.
_PART = "lang string, kind int, word string, n long"
_WORD, _DOCS = -1, _CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts and character classes of a task's texts, by language."""
    schema = arrow_schema(_PART)

    def told(words: dict, chars: dict):
        for lang in words:
            rows = [(_WORD, w.decode(errors="replace"), n) for w, n in words[lang].items()] + [(k, None, int(n)) for k, n in enumerate(chars[lang])]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "kind": [k for k, _, _ in rows], "word": [w for _, w, _ in rows], "n": [n for _, _, n in rows]}, schema=schema)

    words: dict[str, Counter] = {}
    chars: dict[str, np.ndarray] = {}
    for langs, texts in rows_of(batches, "lang", "text"):
        for lang, text in zip(langs, texts):
            raw = text.encode()
            words.setdefault(lang, Counter()).update(raw.lower().split())
            chars[lang] = chars.get(lang, 0) + np.append(char_classes(raw), 1)  # the last one counts documents
        if sum(map(len, words.values())) > 500_000:
            yield from told(words, chars)
            words, chars = {}, {}
    yield from told(words, chars)


def references(docs: DataFrame) -> list[tuple[str | None, list[float], dict[str, float]]]:
    """(language, parts of character classes, parts of common words) of all languages that count, over all documents."""
    counts = docs.select(F.col("lang").cast("string").alias("lang"), or_empty("text").alias("text")).mapInArrow(_count, _PART)
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.save(counts.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "counts")
    is_word = F.col("kind") == _WORD
    totals = counts.groupBy("lang").agg(F.sum(F.when(is_word, F.col("n"))).alias("total"), F.sum(F.when(F.col("kind") == _DOCS, F.col("n"))).alias("docs"))
    large = {r["lang"]: r["total"] for r in totals.where((F.col("total") >= LEAST_WORDS) & (F.col("docs") >= LEAST_DOCS)).collect()}
    if not large:
        scratch.drop(counts)
        return []
    least = docs.sparkSession.createDataFrame([(k, WORD_PART * n) for k, n in large.items()], "_lang string, _least double")
    own = counts.join(F.broadcast(least), F.col("lang").eqNullSafe(F.col("_lang")))
    by: dict[str | None, list] = {lang: [] for lang in large}
    for r in own.where(~is_word | (F.col("n") >= F.col("_least"))).collect():
        by[r["lang"]].append((r["kind"], r["word"], r["n"]))
    scratch.drop(counts)
    out = []
    for lang, total in sorted(large.items(), key=lambda x: (x[0] is None, x[0] or "")):
        chars = np.zeros(_CLASSES)
        for kind, _, n in by[lang]:
            if 0 <= kind < _CLASSES:
                chars[kind] = n
        common = {word: n / total for kind, word, n in by[lang] if kind == _WORD}
        out.append((lang, (chars / max(1.0, chars.sum())).tolist(), dict(sorted(common.items()))))
    return out


_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_divergence double, common_divergence double"


def _judge(refs, columns: list[str], schema: pa.Schema):
    char_refs = np.array([c for _, c, _ in refs]).reshape(len(refs), _CLASSES)
    tables = []
    for _, _, common in refs:
        place = {w.encode(): k for k, w in enumerate(common)}
        parts = np.array([*common.values(), max(0.0, 1 - sum(common.values()))])
        tables.append((place, parts))

    own_langs = {lang for lang, _, _ in refs}

    def verdict(raw: bytes, words: list[bytes], classes: np.ndarray, lang: str | None) -> tuple[float | None, float | None, bool]:
        """Both divergences from the nearest language, and whether its common words are missing."""
        if lang not in own_langs or not words:
            return None, None, False
        chars = divergence(classes / classes.sum(), char_refs)
        lower = Counter(raw.lower().split())
        best = (np.inf, 0, 0.0, False)  # the sum of both divergences, the language, the second divergence, common words missing
        for k in np.argsort(chars, kind="stable").tolist():
            if chars[k] > best[0]:
                break
            place, parts = tables[k]
            own = np.zeros(len(parts))
            for w in lower.keys() & place.keys():
                own[place[w]] = lower[w]
            few = own.sum() < LEAST_COMMON * len(words) * (1 - parts[-1]) and len(words) * (1 - parts[-1]) >= EXPECTED
            own[-1] = len(words) - own.sum()
            common = float(divergence(own / len(words), parts))
            best = min(best, (float(chars[k]) + common, k, common, bool(few)))
        return float(chars[best[1]]), *best[2:]

    def rules(text: str, lang: str | None) -> tuple:
        raw = text.encode()
        words, classes = raw.split(), char_classes(raw)
        n, again = len(words), repeated_words(words)
        failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
        *far, few = verdict(raw, words, classes, lang)
        unlike = n >= GUARD_CHARS and far[0] is not None and far[0] > MAX_CHARS or n >= GUARD_WORDS and far[1] is not None and (far[1] > MAX_COMMON or few)
        return n, int(classes.sum() - classes[3] - classes[4]), int(classes[6]), repeated_lines(text), again, failed, not failed and not unlike, *far

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts, langs = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "_lang"))
                made = list(zip(*(rules(t or "", lang) for t, lang in zip(texts, langs))))
                kept = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(made, schema.types[len(columns) :]))], schema=schema)

    return judge


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rules' counts and verdict for each document, beside the columns of keep.

    First pass: histograms of character classes and of words over all documents, by the column lang; a language's
    common words are those with WORD_PART of its words. Second pass: a document's two histograms are held against the
    nearest language whatever its lang says; it fails where they diverge too far, or the language's common words are missing, and it has words enough to tell. The
    base rules alone judge documents whose lang has no reference, as it has under LEAST_WORDS words or LEAST_DOCS documents.
    word_chars counts code points in words. A null text is empty: it has no words and fails the base rules. Null lang
    is a language of its own; of languages that are equally near the first by name counts; very long texts are judged
    whole; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    refs = references(docs)
    rows = docs.withColumns({"text": F.col("text").cast("string"), "_lang": F.col("lang").cast("string")})
    fields = [f for f in rows.schema.fields if f.name in keep]
    out = T.StructType([*fields, *T._parse_datatype_string(_RULES).fields])
    names = [f.name for f in fields]
    source = rows.select(*dict.fromkeys([*names, "text", "_lang"]))
    return source.mapInArrow(_judge(refs, names, to_arrow_schema(out)), out)
