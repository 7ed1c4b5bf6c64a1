"""Scalar operators that SQL functions cannot state, as Arrow (pandas) UDFs. Null text counts as empty."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that run together, and their parting.
GLUED = {
    "chủnghĩa": "chủ nghĩa", "tựdo": "tự do", "đồán": "đồ án", "đềtài": "đề tài", "tựđộng": "tự động", "sửdụng": "sử dụng", "hệthống": "hệ thống", "ngữnghĩa": "ngữ nghĩa",
    "tựkhóa": "từ khóa", "tựnhiên": "tự nhiên", "xửlý": "xử lý", "ngữcảnh": "ngữ cảnh", "họtên": "họ tên", "nộidung": "nội dung", "kếtquả": "kết quả", "đạtđược": "đạt được",
    "cánbộ": "cán bộ", "sinhviên": "sinh viên", "phânhiệu": "phân hiệu", "bộmôn": "bộ môn", "tiếnđộ": "tiến độ", "thựchiện": "thực hiện", "hướngdẫn": "hướng dẫn", "môhình": "mô hình",
    "tiếngviệt": "tiếng Việt", "dunglượng": "dung lượng", "bằngcách": "bằng cách", "ngắngọn": "ngắn gọn", "huấnluyện": "huấn luyện", "bộnhớ": "bộ nhớ", "ngônngữ": "ngôn ngữ",
    "trảlời": "trả lời", "chínhxác": "chính xác", "nghiêncứu": "nghiên cứu", "pháttriển": "phát triển", "dựán": "dự án", "thôngtin": "thông tin", "tốtnghiệp": "tốt nghiệp", "côngnghệ": "công nghệ",
    "họctập": "học tập", "vănbản": "văn bản", "lấydúng": "lấy đúng", "chạythử": "chạy thử", "trênmáy": "trên máy", "trànbộ": "tràn bộ", "độthực": "độ thực", "ngữtự": "ngữ tự",
    "nhỏnội": "nhỏ nội", "đểhệ": "để hệ", "đểlấy": "để lấy", "đểtạo": "để tạo", "vụhuấn": "vụ huấn", "thửtrên": "thử trên", "bộhướng": "bộ hướng", "cánbộhướng": "cán bộ hướng",
    "độc lập": "độc lập", "hạnh phúc": "hạnh phúc", "độchính": "độ chính", "câutrả": "câu trả", "nghệthông": "nghệ thông",
}
_GLUED = re.compile("|".join(sorted(map(re.escape, GLUED), key=len, reverse=True)), re.IGNORECASE)


#: Letters that match others without case, though lower case does not make them those.
_FOLDED = re.compile("[ſıİ]")


def part_glued(text: str) -> str:
    """Glued words parted. All of them hold letters beyond ASCII, and few texts hold any: the pattern is tried only where one is found."""
    if text.isascii():
        return text
    low = text.lower()
    if not any(w in low for w in GLUED) and not _FOLDED.search(text):
        return text

    def one(m: re.Match) -> str:
        w, to = m[0], GLUED[m[0].lower()]
        return to.upper() if w.isupper() else to[0].upper() + to[1:] if w[0].isupper() else to

    return _GLUED.sub(one, text)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    return " ".join(" ".join(p.parts).split())


def clean_generation(text: str) -> str:
    """Model output without special tokens, repeated 1- to 4-word runs, leading symbols and an unfinished last sentence."""
    t = unicodedata.normalize("NFC", text).replace("▁", " ")
    t = re.sub(r"<extra_id_\d+>|<\s*/?\s*(?:pad|unk|s|eos|sep|cls|mask)\s*>", " ", t, flags=re.I)
    for n in (1, 2, 3, 4):
        t = re.sub(rf"\b(\w+(?:\s+\w+){{{n - 1}}})(?:\s+\1\b)+", r"\1", t, flags=re.I)
    t = re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s+", " ", t))
    t = re.sub(r"^[^\w]+", "", t).strip()
    ends = list(re.finditer(r'[.!?…]["”]?', t))
    return t[: ends[-1].end()] if ends else t


def embed(text: str, dim: int) -> np.ndarray:
    """Signed feature hashing of white-space words, L2-normalised."""
    v = np.zeros(dim, np.float32)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1 if (h >> 63) & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


class _Hashes(dict):
    """64-bit hashes of words, each made once while no more than ``MOST`` are held."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return h


_HASHES = _Hashes()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each white-space word of ``texts`` in lower case, words of each text)."""
    words = [t.lower().split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((_HASHES[w] for x in words for w in x), np.uint64, int(size.sum())), size


def hashed_vectors(hashes: np.ndarray, size: np.ndarray, dim: int) -> np.ndarray:
    """The vectors that ``embed`` makes, a row for each text, from ``word_hashes``."""
    cell = np.repeat(np.arange(len(size)) * dim, size) + (hashes % np.uint64(dim)).astype(np.int64)
    v = np.bincount(cell, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(size) * dim).reshape(len(size), dim)
    square = (v * v).sum(1)
    v = v.astype(np.float32)
    norm = np.sqrt(square.astype(np.float32))
    for i in np.flatnonzero(square >= 1 << 24):  # no whole numbers in single precision, so as ``embed`` has them
        norm[i] = np.linalg.norm(v[i])
    return np.divide(v, norm[:, None], out=v, where=norm[:, None] > 0)


def parts(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """``texts`` in runs of about ``chars`` characters."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def embed_all(texts: list[str], dim: int) -> np.ndarray:
    """``embed`` of each of ``texts``, a row each; the words of about a million characters are held at a time."""
    return np.concatenate([np.zeros((0, dim), np.float32), *[hashed_vectors(*word_hashes(p), dim) for p in parts(texts)]])


def _text(f):
    return F.pandas_udf(lambda s: s.fillna("").map(f), T.StringType())


nfc = _text(lambda x: unicodedata.normalize("NFC", x))
fix_glued_words = _text(part_glued)
strip_html = _text(html_text)
clean_generated = _text(clean_generation)
cache_key_blake = _text(lambda x: hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


#: Punctuation that counts as its ASCII form.
PUNCTUATION = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "...", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": ""})
#: Control characters but line feed and tab (Unicode's Cc is these two ranges), and what is neither letter, digit nor a symbol that stays; marks are looked at one by one.
_CONTROL, _SYMBOL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]"), re.compile(r"""[^\w \n\t.,;:!?()/%+\-|"']""")


def element_text(text: str, kind: str) -> str:
    """An element's text: glued words parted, NFC, hyphens at line ends closed, control and zero-width characters out, plain punctuation; a table keeps its lines and symbols."""
    t = unicodedata.normalize("NFC", part_glued(text)).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(?<=\w)-\n(?=\w)", "", t)
    t = _CONTROL.sub(" ", t).translate(PUNCTUATION)
    if kind == "table":
        return "\n".join(" ".join(x.split()) for x in t.split("\n")).strip()
    return " ".join(_SYMBOL.sub(lambda m: m[0] if unicodedata.category(m[0])[0] == "M" else " ", t).split())


def clean_element(column, kind):
    """Element-level cleaning by the element's kind ("table" keeps line feeds)."""
    return F.pandas_udf(lambda s, k: pd.Series([element_text(x or "", y or "") for x, y in zip(s, k)]), "string")(column, kind)


def hash_embed(column, dim: int = 256):
    return F.pandas_udf(lambda s: pd.Series(list(embed_all(s.fillna("").tolist(), dim)), dtype=object), "array<float>")(column)


def synonym_augment(column, key, table: dict[str, str], rate: float = 0.2):
    """Replace a word by its synonym where the digest of (key, position) falls below ``rate``."""

    def one(text: str, k) -> str:
        words = text.split()
        pick = lambda i: int(hashlib.md5(f"{k}|{i}".encode()).hexdigest()[:8], 16) / 2**32 < rate
        return " ".join(table.get(w, w) if pick(i) else w for i, w in enumerate(words))

    return F.pandas_udf(lambda s, k: pd.Series([one(x or "", y) for x, y in zip(s, k)]), "string")(column, key)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one numpy row at a time."""
    if not a or not b:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(b))}
    y = np.array([ids[w] for w in b])
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        step = row.copy()
        step[1:] = np.where(y == ids.get(w, -1), row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(step)
    return int(row[-1])


def rouge_l(prediction, reference):
    """F1 of the longest common subsequence over ASCII words."""

    def one(p: str, r: str) -> float:
        a, b = (re.findall(r"[a-z0-9]+", (x or "").lower()) for x in (p, r))
        n = lcs(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return F.pandas_udf(lambda p, r: pd.Series([one(x, y) for x, y in zip(p, r)]), "double")(prediction, reference)


def lcs_positions(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``b`` of one longest common subsequence with ``a``."""
    rows = [np.zeros(len(b) + 1, np.int32)]
    for w in a:
        same = np.fromiter((x == w for x in b), bool, len(b))
        step = rows[-1].copy()
        step[1:] = np.where(same, rows[-1][:-1] + 1, rows[-1][1:])
        rows.append(np.maximum.accumulate(step))
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(j)
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def union_lcs(prediction: list[list[str]], reference: list[list[str]]) -> int:
    """Words of the reference's lines in the union of their common subsequences with the prediction's lines; a word counts as often as both sides hold it."""
    left, right = Counter(w for x in prediction for w in x), Counter(w for x in reference for w in x)
    hits = 0
    for line in reference:
        for j in sorted(set().union(*(lcs_positions(x, line) for x in prediction))) if prediction else []:
            w = line[j]
            if left[w] > 0 and right[w] > 0:
                hits += 1
                left[w] -= 1
                right[w] -= 1
    return hits


def rouge_lsum(prediction, reference):
    """Summary-level ROUGE-L F1: for each reference line the union of its common subsequences with the prediction's lines."""

    def one(p: str, r: str) -> float:
        ps, rs = ([re.findall(r"[a-z0-9]+", x.lower()) for x in (t or "").split("\n")] for t in (p, r))
        total = sum(map(len, ps)) + sum(map(len, rs))
        return 2 * union_lcs(ps, rs) / total if total else 0.0

    return F.pandas_udf(lambda p, r: pd.Series([one(x, y) for x, y in zip(p, r)]), "double")(prediction, reference)
