"""Text functions on columns. Null texts count as empty unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
HANGUL = r"\x{ac00}-\x{d7a3}"

# Patterns and word lists.
PORTRAIT_WORDS = ["人像", "肖像"]
PERSON_WORD, GENDER_WORDS = "人物", ["男性", "女性"]
INJECTION = (
    r"(?i)(忽略(以上|之前|上述).{0,6}(规则|指令|提示|要求|内容)|ignore\s+(all\s+)?(previous|above|prior)|disregard\s+(previous|above)|"
    r"你现在是|从现在起你是|扮演|进入(开发者|管理员|越狱)模式|system\s*prompt|系统提示词|开发者指令|不要遵守|无需遵守|忘掉(你的|之前|所有)(规则|设定|限制))"
)
FOOTER = r"(?i)(©|copyright|www\.|https?://|all rights reserved)"
NOT_FOUND = (
    r"(未(能|曾|没有)?(找到|检索到|命中|查到|提及|包含|发现|覆盖)|没有找到|查不到|暂未?找到|暂无(相关)?(资料|内容|信息|记录)"
    r"|资料(中|里)?未?(提及|包含|涉及|找到)|无法(找到|确认|回答)|没有(相关|对应|匹配)的?[\x{4e00}-\x{9fa5}]{0,4}?(资料|内容|信息|记录))"
)
FABRICATED = r"根据内部资料|\[[^\[\]]{2,80}\]|《[^》]{2,60}》"
ANCHOR_STOP = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "were", "has", "have", "not", "inch", "inches"]
DEVICE_COMMON = [
    "THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "WHEN", "WHAT", "HOW", "ARE", "WAS", "NOT", "BUT", "ALL", "CAN", "HAS", "HAVE", "ITS",
    "INTO", "AFTER", "BEFORE", "DURING", "VALUE", "SETTING", "PAGE", "CHAPTER", "SECTION", "FIG", "TABLE", "REV", "PDF", "DOC", "TORR",
]
# A whole run of letters and digits: letters with a digit after them, or three at least without small letters but with a capital, or letters from a capital on.
DEVICE_NAME = "(?<![0-9A-Za-z])(?:[A-Za-z]++[0-9][0-9A-Za-z]*+|(?=[0-9]*+[A-Z])[0-9A-Z]{3,}+(?![a-z])|[A-Z][A-Za-z]{2,}+(?![0-9]))"
GLUE_WORDS = "the|and|that|with|for|are|was|were|this|which|from|been|have|into|using|used|will|than|then|these|those"
KEY_PUNCTUATION = r"[\s，。、;；:：,\.\"'“”‘’「」『』【】\[\]()（）·—\-]"
FINGERPRINT_PUNCTUATION = r"[\s　，。！？；：、,.!?;:\"'（）()\[\]【】<>《》…\-_/\\]+"
MODALITIES = ["pdf", "docx", "pptx", "xlsx", "mp4", "cad"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``use`` has lambdas that would work the value out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squashed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(filled(c), r"\s+", "")


def spaced(c: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(filled(c), r"\s+", " "))


def pieces(c: Column, size: int, step: int = 1) -> Column:
    """Distinct substrings of ``size`` characters, ``step`` apart; the whole text if it is shorter."""
    starts = lambda t: F.sequence(F.lit(1), F.length(t) - size + 1, F.lit(step))
    return once(c, lambda t: F.when(F.length(t) >= size, F.array_distinct(F.transform(starts(t), lambda i: F.substring(t, i, F.lit(size))))).otherwise(F.array(t)))


def shingles(c: Column, size: int = 8) -> Column:
    """Distinct ``size``-character shingles of the text without white space."""
    return pieces(squashed(c), size)


def alarm_codes(c: Column) -> Column:
    """Runs of 3 to 5 digits that touch no digit, dot or comma; years 19xx and 20xx are none."""
    found = F.regexp_extract_all(filled(c), F.lit(r"(?<![\d.,])\d{3,5}(?![\d.,])"), F.lit(0))
    return F.filter(found, lambda x: ~x.rlike(r"^(19|20)\d\d$"))


def holds_any_code(content: Column, codes: Column) -> Column:
    """A code stands in the content with the same boundaries."""
    return F.size(F.array_intersect(F.regexp_extract_all(filled(content), F.lit(r"(?<![\d.,])\d{3,5}(?![\d.,])"), F.lit(0)), codes)) > 0


def is_portrait(c: Column) -> Column:
    c = filled(c)
    head = F.lit(False)
    for w in PORTRAIT_WORDS:
        head = head | c.contains(w)
    gender = c.contains(GENDER_WORDS[0]) | c.contains(GENDER_WORDS[1])
    return head | (c.contains(PERSON_WORD) & gender)


def is_injection(c: Column) -> Column:
    return filled(c).rlike(INJECTION)


def says_not_found(c: Column) -> Column:
    return filled(c).rlike(NOT_FOUND)


def has_citation(c: Column) -> Column:
    return filled(c).rlike(FABRICATED)


def is_page_number(c: Column) -> Column:
    t = F.trim(filled(c))
    return (F.length(t) <= 4) & t.rlike(r"^(\d+|\d+\s*/\s*\d+)$")


def is_noise(c: Column, df: Column, threshold: Column) -> Column:
    """Page numbers, short footers, punctuation, and texts up to 120 characters that many pages have."""
    return is_page_number(c) | ((F.length(c) <= 80) & c.rlike(FOOTER)) | c.rlike(r"^[^\p{L}\p{N}]*$") | ((F.coalesce(df, F.lit(0)) >= threshold) & (F.length(c) <= 120))


def without_inline_tags(c: Column) -> Column:
    """Breaks and tags become spaces, then common entities are decoded, then spaces are collapsed."""
    t = F.regexp_replace(filled(c), r"(?i)<br\s*/?>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    # Entities; the ampersand comes last.
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return spaced(t)


def table_rows(html: Column) -> Column:
    """Rows of an HTML table: non-empty cells joined by `` | ``; rows without a cell are left out."""
    rows = F.regexp_extract_all(filled(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), without_inline_tags), lambda x: x != "")
    return F.filter(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), lambda x: x != "")


def has_header_row(rows: Column) -> Column:
    """The first row has two cells at least, and not fewer than half of the second's."""
    n = lambda i: F.size(F.filter(F.split(F.coalesce(F.get(rows, F.lit(i)), F.lit("")), r"\|"), lambda x: F.trim(x) != ""))
    return (n(0) >= 2) & ~((F.size(rows) >= 2) & (n(1) > 0) & (n(0) < n(1) / 2))


def glued_words(c: Column) -> Column:
    """Number of runs of 24 lower-case letters or more with an English function word after the third letter."""
    return F.size(F.filter(F.regexp_extract_all(filled(c), F.lit("[a-z]{24,}"), F.lit(0)), lambda t: F.substring(t, 4, 1 << 20).rlike(GLUE_WORDS)))


def is_numbered_heading(c: Column) -> Column:
    """A short text that is numbered like a heading, without a sentence in it."""
    t = F.trim(filled(c))
    short = (F.length(t) >= 2) & (F.length(t) <= 40) & ~t.rlike(r"[。.!?！？]$") & ~t.rlike(r"[。！？…]|\s[.!?]\s") & ~t.rlike(r"\d{1,2}\s*[.、．].*\d{1,2}\s*[.、．]")
    word = rf"[{CJK}{HANGUL}]"
    marked = (
        t.rlike(r"^第\s*[一二三四五六七八九十百千0-9]+\s*[章节条部分]")
        | t.rlike(rf"^[가나다라마바사아자차카타파하][．.、]\s*{word}")
        | t.rlike(rf"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮]\s*{word}")
    )
    rest = F.trim(F.regexp_extract(t, r"^\d{1,2}(?:[．.]\d{1,2}){0,3}[\s．.、]+(\S.*)$", 1))
    title = (F.size(F.split(rest, r"\s+")) <= 4) & rest.rlike(r"^\p{Lu}")
    return short & (marked | ((rest != "") & (rest.rlike(word) | title)))


def heading_number(c: Column) -> Column:
    """struct(family, value) of a leading number; null if there is none."""
    t = F.trim(filled(c))
    circled, jamo = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮", "가나다라마바사아자차카타파하"
    first = F.substring(t, 1, 1)
    digits = F.regexp_extract(t, r"^(\d{1,2})\s*[．.、)]\s*\S", 1)
    kind = F.when(t.rlike(f"^[{circled}]"), "circled").when(t.rlike(rf"^[{jamo}][．.、]"), "jamo").when(digits != "", "numeric")
    value = F.when(kind == "circled", F.instr(F.lit(circled), first)).when(kind == "jamo", F.instr(F.lit(jamo), first)).when(kind == "numeric", F.expr("1") * digits.try_cast("int"))
    return F.when(kind.isNotNull(), F.struct(kind.alias("family"), value.cast("int").alias("value")))


def device_tokens(c: Column, most: int = 16) -> Column:
    """Model names: letter-digit mixes and capitals first, then capitalised words; upper case, distinct."""
    found = F.regexp_extract_all(filled(c), F.lit(DEVICE_NAME), F.lit(0))
    strong = lambda f: f.rlike("[0-9]") | (f == F.upper(f))
    ordered = lambda names: F.concat(F.filter(names, strong), F.filter(names, lambda f: ~strong(f)))
    names = once(F.filter(found, lambda f: ~F.upper(f).isin(DEVICE_COMMON)), ordered)
    return F.slice(F.array_distinct(F.transform(names, F.upper)), 1, most)


def numbers(c: Column) -> Column:
    """Distinct numbers of 10 and more: thousands separators dropped, the units 万 and 千 applied, whole numbers without a point."""
    found = F.regexp_extract_all(filled(c), F.lit(r"\d[\d,，]*(?:\.\d+)?\s*[万千]?"), F.lit(0))

    def value(x: Column) -> Column:
        v = F.regexp_replace(F.regexp_extract(x, r"^([\d,，.]+)", 1), "[,，]", "").try_cast("double")
        return v * F.when(x.endswith("万"), 10000.0).when(x.endswith("千"), 1000.0).otherwise(1.0)

    big = F.filter(F.transform(found, value), lambda v: v >= 10)
    return F.array_distinct(F.transform(big, lambda v: F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))))


def sentences(c: Column) -> Column:
    """Cut after 。 ! ? ； ; and line ends; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(filled(c), r"(?<=[。!?;；\n])"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def norm_key(c: Column) -> Column:
    return F.regexp_replace(filled(c), KEY_PUNCTUATION, "")


def fingerprint(question: Column, answer: Column) -> Column:
    """SHA-1 of both texts in lower case, without white space and punctuation, 300 characters each."""
    part = lambda c: F.substring(F.regexp_replace(F.lower(F.trim(filled(c))), FINGERPRINT_PUNCTUATION, ""), 1, 300)
    return F.sha1(F.concat(part(question), F.lit("|"), part(answer)).cast("binary"))


def anchors(c: Column) -> Column:
    """Words of three Latin letters and more, and numbers, in lower case, without stop words."""
    found = F.transform(F.regexp_extract_all(filled(c), F.lit(r"[A-Za-z]{3,}|\d+(?:\.\d+)?"), F.lit(0)), F.lower)
    return F.filter(found, lambda x: ~x.isin(ANCHOR_STOP))


def anchor_share(wanted: Column, content: Column) -> Column:
    """Share of the anchors that the content holds; 0 without anchors."""
    share = lambda low, w: F.size(F.filter(w, lambda a: F.contains(low, a))) / F.size(w)
    return once(wanted, lambda w: F.when(F.size(w) > 0, once(F.lower(filled(content)), lambda low: share(low, w))).otherwise(F.lit(0.0)))


def bigram_coverage(fact: Column, content: Column) -> Column:
    """Share of the fact's distinct character pairs (of 120 normalised characters) found in the content."""
    norm = lambda c: F.regexp_replace(F.lower(filled(c)), rf"[^a-z0-9{CJK}]+", "")
    f = F.substring(norm(fact), 1, 120)
    share = lambda pairs, c: F.size(F.filter(pairs, lambda g: F.contains(c, g))) / F.size(pairs)
    return F.when(F.length(f) < 6, 0.0).otherwise(once(pieces(f, 2), lambda pairs: once(norm(content), lambda c: share(pairs, c))))


def token_estimate(c: Column) -> Column:
    """CJK characters plus 1.3 for each word, whole."""
    t = filled(c)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    return F.floor(F.regexp_count(t, F.lit(rf"[{CJK}]")) + words * F.lit(1.3)).cast("int")


def truncated(c: Column, n: int, mark: str = "…[已截断]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def looks_like_toc(c: Column, lines: int = 5, share: float = 0.4) -> Column:
    """Leaders, or many lines of which a large share ends in a number."""
    own = F.filter(F.transform(F.split(filled(c), "\n"), F.trim), lambda x: x != "")
    ends = F.size(F.filter(own, lambda x: x.rlike(r"\d+\s*$")))
    return filled(c).rlike(r"\.\.\.|．．|…") | ((F.size(own) >= lines) & (ends / F.size(own) >= share))


def sub_questions(c: Column, least: int = 6, most: int = 3) -> Column:
    """Independent questions of a composite one; empty if there are fewer than two."""
    parts = F.transform(F.split(filled(c), r"[？?；;]\s*"), lambda p: F.regexp_replace(F.trim(p), r"^(?:[0-9①②③④⑤]+[.、)〕]\s*|[第一二三四五六七八九十]+[,，]\s*)", ""))
    good = F.filter(parts, lambda p: F.length(p) >= least)
    return F.when(F.size(good) >= 2, F.slice(good, 1, most)).otherwise(F.array().cast("array<string>"))


def scope_stem(c: Column) -> Column:
    """Document family for scopes: without ``_p<from>-<to>`` or ``_p<from>_``."""
    return F.regexp_replace(filled(c), r"_p\d+[_-]\d*$", "")


def seat_stem(c: Column) -> Column:
    """Document family for seat caps: without ``_p<from>`` or ``_p<from>-<to>``."""
    return F.regexp_replace(filled(c), r"_p\d+(?:-\d+)?$", "")


def physical_page(stem: Column, page: Column) -> Column:
    """Page of the whole document, from 1; null for a missing, negative or zero page."""
    start = F.regexp_extract(filled(stem), r"^(.*)_p(\d+)-(\d+)$", 2).try_cast("int")
    return F.when(page > 0, F.coalesce(start, F.lit(1)) + page).cast("int")


def source_tokens_hit(expected: Column, stem: Column) -> Column:
    """Every Latin or CJK run of the expected name is in the normalised stem; an empty name is a hit."""
    runs = F.regexp_extract_all(F.lower(filled(expected)), F.lit(rf"[a-z0-9]+|[{CJK}]+"), F.lit(0))
    return once(F.regexp_replace(F.lower(filled(stem)), rf"[^a-z0-9{CJK}]+", ""), lambda low: F.forall(runs, lambda t: F.contains(low, t)))


def loose(c: Column) -> Column:
    """Letters, digits and CJK characters only, in lower case."""
    return F.lower(F.regexp_replace(filled(c), rf"[^0-9A-Za-z{CJK}]", ""))


def window_coverage(fragment: Column, material: Column, window: int = 12, step: int = 4) -> Column:
    """Share of the windows of the (loose) fragment that the (loose) material holds."""
    wins = once(fragment, lambda f: F.transform(F.sequence(F.lit(1), F.length(f) - window + 1, F.lit(step)), lambda i: F.substring(f, i, F.lit(window))))
    long = once(wins, lambda ws: once(material, lambda m: F.size(F.filter(ws, lambda w: F.contains(m, w))) / F.size(ws)))
    return F.when(F.length(fragment) > window, long).otherwise(F.contains(material, fragment).cast("double"))


def object_key(path: Column, root: str = "D:/clean", prefix: str = "kept") -> Column:
    """Object key of an absolute path below ``root`` on any platform; null elsewhere.

    A first folder that is no modality gets ``pdf/`` before it; ``cad`` stays without the prefix.
    """
    clean = F.replace(filled(path), F.lit("\\"), F.lit("/"))
    drive = F.upper(F.regexp_extract(clean, r"^([A-Za-z]:)/", 1))
    body = F.regexp_replace(clean, r"^([A-Za-z]:|//[^/]+)?/", "")
    parts = F.filter(F.split(body, "/"), lambda x: ~x.isin("", "."))
    want = [x for x in root.replace("\\", "/").split("/") if x and not x.endswith(":")]
    own = root[:2].upper() if root[1:2] == ":" else ""
    inside = clean.rlike(r"^([A-Za-z]:)?/") & ((drive == own) | (drive == "") | F.lit(own == "")) & (F.slice(parts, 1, len(want)) == F.array(*map(F.lit, want))) & (F.size(parts) > len(want))
    rel = F.slice(parts, len(want) + 1, 1 << 20)
    first = F.lower(F.get(rel, F.lit(0)))
    joined = F.array_join(rel, "/")
    placed = F.when(first.isin(MODALITIES), joined).otherwise(F.concat(F.lit("pdf/"), joined))
    return F.when(inside, F.when(first == "cad", placed).otherwise(F.concat(F.lit(f"{prefix}/"), placed)))


def user_of_thread(thread: Column) -> Column:
    """The user before the first bar; null without one."""
    return F.when(filled(thread).contains("|"), F.substring_index(thread, "|", 1))


def thread_key(user: Column, thread: Column) -> Column:
    return F.concat(filled(user), F.lit("|"), filled(thread))
