"""Scalar text operators as SQL expressions: ``op(d, x)`` renders in dialect ``d`` over expression ``x``.

Tokenizers are named a to g; each operator says which it takes. ``col(op, x)`` gives a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.dialect import SPARK

#: Word patterns and word lists.
WORD_A = "[A-Za-zÀ-ỹĐđ0-9]+"
WORD_U = "[\\p{L}\\p{N}_]+"
STOP_WORDS = ("và", "của", "các", "những", "một", "trong", "cho", "với", "được", "đã", "là", "có", "không", "này", "đó", "từ", "khi", "về", "theo", "sau", "trước", "tại", "để", "nhiều", "người", "năm", "ngày", "ra", "vào")
WATCHED_WORDS = ("the", "of", "and", "de", "la", "le", "que", "el", "der", "die", "und", "en", "is", "to", "a")
MARKS = "[ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵĂÂĐÊÔƠƯÁÀẢÃẠẮẰẲẴẶẤẦẨẪẬÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ]"


def col(op, x: str, *args) -> Column:
    """The operator as a Spark Column over the SQL expression ``x``."""
    return F.expr(op(SPARK, x, *args))


def text(d, x="text"):
    return f"coalesce({x}, '')"


def low(d, a):
    return d.map(a, "lower(x)")


# tokenizers
def tok_a(d, x="text"):
    return low(d, d.rx_all(text(d, x), WORD_A))


def tok_a_content(d, x="text"):
    stop = d.array(*(d.lit(w) for w in STOP_WORDS))
    return d.filter(tok_a(d, x), f"length(y) > 1 AND NOT {d.has(stop, 'y')}", "y")


def tok_b(d, x="text"):
    return low(d, d.rx_all(text(d, x), "[\\p{L}\\p{N}_À-ỹĐđ]+"))


def tok_c(d, x="text"):
    return d.rx_all(f"lower({text(d, x)})", WORD_U)


def tok_d(d, x="text"):
    return d.filter(tok_c(d, x), "length(y) > 1", "y")


def tok_e(d, x="text"):
    return d.filter(d.rx_split(f"trim({d.rx_rep(text(d, x), '[\\s]+', ' ')})", " "), "y <> ''", "y")


def tok_f(d, x="text"):
    return d.rx_all(text(d, x), "[\\p{L}\\p{N}_À-ỹĐđ]+|[^\\p{L}\\p{N}_\\s]")


def tok_g(d, x="text"):
    return d.rx_all(f"lower({text(d, x)})", "[a-z0-9]+")


def n_words(d, x="text"):
    return d.size(tok_e(d, x))


# cleaning
def fix_decimals(d, x):
    for p, r in (("(\\d)\\s*\\.\\s*(\\d)", "\\1.\\2"), ("(\\d)\\s*,\\s*(\\d)", "\\1,\\2"), ("(\\d)\\s*-\\s*(\\d)", "\\1-\\2")):
        x = d.rx_rep(x, p, r)
    return x


def punctuation(d, x):
    """Typographic characters to plain ones, runs collapsed, one space after , ; : ! ? and none before a dot."""
    x = f"replace(translate({x}, '‘’“”–—−«»', {d.lit(chr(39) * 2 + chr(34) * 2 + '---' + chr(34) * 2)}), '…', '...')"
    x = d.rx_rep(x, "(?:[!?])+([!?])", "\\1")
    x = d.rx_rep(x, "(?:[,;:])+([,;:])", "\\1")
    x = d.rx_rep(x, "\\.{3,}", "...")
    x = d.rx_rep(x, "(^|[^0-9])\\.([A-Za-zÀ-ỹĐđ])", "\\1. \\2")
    x = d.rx_rep(x, "\\s*([,;:!?])\\s*", "\\1 ")
    return d.rx_rep(x, "\\s+\\.", ".")


def noise(d, x):
    keep = "\\p{L}\\p{N}_\\sÀ-ỹĐđ.,!?;:'\"()/%+\\-"
    x = d.rx_rep(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " ")
    x = d.rx_rep(x, "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{FEFF}]", "")
    x = d.rx_rep(x, f"[^{keep}]{{2,}}", " ")
    return d.rx_rep(x, f"[^{keep}]", " ")


def white_space(d, x):
    x = d.rx_rep(x, "[\\r\\t]+", " ")
    x = d.rx_rep(x, "\\n{3,}", "\n\n")
    x = d.rx_rep(x, "([a-z])([A-Z])", "\\1 \\2")
    x = d.rx_rep(x, "[ ]{2,}", " ")
    x = d.rx_rep(x, "[ ]*\\n[ ]*", "\n")
    return d.rx_rep(x, "^\\s+|\\s+$", "")


def strip_tags(d, x):
    """Regular-expression variant: tags to spaces, the five named entities decoded."""
    x = d.rx_rep(x, "<[^>]+>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', {d.lit(c)})"
    return x


def strip_urls(d, x):
    x = d.rx_rep(x, "(?i)https?://[^\\s]+|www\\.[^\\s]+", " ")
    return d.rx_rep(x, "[^\\s]+@[^\\s]+\\.[A-Za-z0-9_]+", " ")


def dehyphenate(d, x):
    return d.rx_rep(x, "([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])", "\\1\\2")


def editorial_line(d, x):
    """Bare numbers, n / m, short photo credits and source lines, blank lines."""
    return f"({x} = '' OR {d.rx_like(x, '^[0-9]{1,3}$')} OR {d.rx_like(x, '^[0-9]+ */ *[0-9]+$')} OR (length({x}) < 150 AND ({d.rx_like(f'lower({x})', '(^|[^a-zà-ỹđ])ảnh *:')} OR {d.rx_like(f'lower({x})', '^theo +(vne|vnexpress)')})))"


def headline_key(d, x):
    return f"substring({d.rx_rep(f'lower({x})', '[ ]+', ' ')}, 1, 140)"


def clean(d, x):
    """Non-aggressive cleaning without the steps that need tables or a parser."""
    return fix_decimals(d, white_space(d, noise(d, fix_decimals(d, punctuation(d, text(d, x))))))


def trim_incomplete(d, x):
    """Up to the last sentence end, or all of it if there is none."""
    t = f"trim({text(d, x)})"
    cut = d.rx_get(t, "(?s)^(.*[.!?…][\"”]?)", 1)
    return f"CASE WHEN {cut} = '' THEN {t} ELSE {cut} END"


def safe_filename(d, x):
    return d.rx_rep(x, "[^\\p{L}\\p{N}._\\- ]", "")


def first_words(d, x, n):
    return d.join(d.slice(tok_e(d, x), "1", str(n)), " ")


# sentences
def _pieces(d, x, ends, also_lines=True):
    if d.name == "spark":
        a = d.rx_split(x, f"(?<=[{ends}])\\s+" + ("|\\n+" if also_lines else ""))
    else:
        mark = "\x01"
        a = d.rx_split(d.rx_rep(x, f"([{ends}])\\s+", "\\1" + mark), mark + ("|\\n+" if also_lines else ""))
    return d.filter(d.map(a, d.rx_rep("x", "^\\s+|\\s+$", "")), "y <> ''", "y")


def sentences_a(d, x="text"):
    return _pieces(d, clean(d, x), ".!?")


def sentences_raw(d, x="text"):
    """Splitter a without the cleaning before it."""
    return _pieces(d, text(d, x), ".!?")


def sentences_b(d, x="text"):
    return _pieces(d, text(d, x), ".!?。！？")


def sentences_c(d, x="text"):
    return _pieces(d, text(d, x), ".!?", also_lines=False)


# predicates and ratios
def ratio(d, n, m):
    return f"({d.double(n)} / greatest(1, {m}))"


def letters(d, x):
    return d.size(d.rx_all(x, "\\p{L}"))


def latin(d, x):
    return d.size(d.rx_all(x, "\\p{IsLatin}" if d.name == "spark" else "\\p{Latin}"))


def foreign_ratio(d, x):
    return f"CASE WHEN {letters(d, x)} = 0 THEN 0.0 ELSE {d.double(f'{letters(d, x)} - {latin(d, x)}')} / {letters(d, x)} END"


def vietnamese_ratio(d, x):
    return f"CASE WHEN {letters(d, x)} = 0 THEN 0.0 ELSE {d.double(d.size(d.rx_all(x, '[À-ỹđĐ]')))} / {letters(d, x)} END"


def garbage(d, x, vietnamese=False):
    base = f"length(trim({text(d, x)})) < 3 OR {foreign_ratio(d, text(d, x))} >= 0.15"
    if vietnamese:
        base += f" OR ({letters(d, text(d, x))} >= 20 AND {vietnamese_ratio(d, text(d, x))} < 0.01)"
    return f"({base})"


def single_ratio(d, toks):
    return ratio(d, d.size(d.filter(toks, "length(y) = 1", "y")), d.size(toks))


def garbled_single(d, x, most=0.15):
    return f"({single_ratio(d, tok_a(d, x))} >= {most})"


def word_loop(d, words, n):
    """Some n-gram occurs three times in a row."""
    gram = lambda at: d.join(d.slice(words, at, str(n)), " ")
    hits = d.filter(d.seq("1", f"{d.size(words)} - {3 * n - 1}"), f"{gram('k')} = {gram(f'k + {n}')} AND {gram('k')} = {gram(f'k + {2 * n}')}", "k")
    return f"({d.size(hits)} > 0)"


def language(d, x):
    s = f"substring({text(d, x)}, 1, 8000)"
    marks, words = d.size(d.rx_all(s, MARKS)), d.size(d.rx_all(s, d.whole("[a-zA-Z]{3,}")))
    return f"CASE WHEN {marks} >= 8 OR ({marks} >= 3 AND {words} >= 20) THEN 'vi' WHEN {words} >= 20 THEN 'en' ELSE 'unknown' END"


def fingerprint(d, x):
    return f"sha1({d.join(tok_a(d, clean(d, x)), ' ')})"
