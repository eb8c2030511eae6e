"""Text and token functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that weigh half a token, and the narrower ones that are terms of their own.
WIDE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"

# Words and characters that are no terms. They are data that results depend on, in their usual order.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "this", "that", "these", "those",
    "it", "its", "i", "you", "he", "she", "we", "they", "my", "your",
    "his", "her", "our", "their", "what", "how", "why", "when", "where",
    "which", "who", "not", "no", "so", "if", "as", "up", "out", "about",
]
STOP_CHARACTERS = [
    "的", "了", "和", "是", "在", "我", "有", "他", "这", "中", "大", "来", "上", "为",
    "与", "个", "到", "说", "就", "也", "都", "会", "那", "很", "好", "么", "但",
    "以", "要", "可", "还", "出", "如", "而", "于", "其", "或", "无",
    "不", "一",
    "啊", "吧", "呢", "嗯", "哦", "哈", "嘛", "吗", "呀", "哇",
]

# Patterns of the blocks and stamps that messages begin with.
SENDER = r"^Sender\s*\(untrusted metadata\):\n```json\n[\s\S]*?```\n*"
STAMP = r"^\[\w{3}\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+GMT[+-]\d+\]\s*"
INTERNAL = r"^<<<BEGIN_[A-Z_]*INTERNAL_CONTEXT>>>[\s\S]*?<<<END_[A-Z_]*INTERNAL_CONTEXT>>>\s*"
_EDGE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def let(value: Column, body) -> Column:
    """body of value, which is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, _EDGE, "")


def tokens(text: Column) -> Column:
    """A quarter of a token for a character, a half for wide ones, rounded up; 0 for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    # Runs go at once, not character by character; a text of ASCII alone has no wide ones.
    wide = F.when(F.octet_length(text) > F.char_length(text), F.char_length(F.regexp_replace(text, f"[^{WIDE}]+", ""))).otherwise(0)
    return ((F.char_length(text) + wide + 3) / 4).cast("long")


def strip_sender(text: Column) -> Column:
    """Without a leading sender block and time stamp, trimmed; the trimmed text if nothing else is left."""
    cut = trim(F.regexp_replace(F.regexp_replace(text, SENDER, ""), STAMP, ""))
    return F.when(cut != "", cut).otherwise(trim(text))


def strip_metadata(text: Column) -> Column:
    """As strip_sender, and without an internal block after it; the text as it is if nothing else is left."""
    cut = trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SENDER, ""), STAMP, ""), INTERNAL, ""))
    return F.when(cut != "", cut).otherwise(text)


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def terms(text: Column) -> Column:
    """Terms in order: runs of ASCII letters, digits, "_" and "-" in lower case, ideographs one by one, without stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_-]+|[{IDEOGRAPHS}])"), F.lit(1)), F.lower)
    # Single characters of ASCII have one byte, ideographs three or four: no pattern is run for each term.
    return F.filter(found, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS, *STOP_CHARACTERS))


def turn_text(user: Column, assistant: Column, tools: Column) -> Column:
    """What a turn's terms are taken from: the non-empty ones of previews and tool names, joined by a space."""
    empty = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", empty(user), empty(assistant), empty(F.array_join(tools, " ")))


def topic_label(user_preview: Column, ordinal: Column) -> Column:
    """Label of a topic by its first turn: 40 characters at most, cut at a space beyond the 24th."""
    text = trim(F.coalesce(user_preview, F.lit("")))
    head = F.substring(text, 1, 40)
    space = F.lit(40) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > 24), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(text == "", F.concat(F.lit("Topic "), (ordinal + 1).cast("string"))).when(F.char_length(text) <= 40, text).otherwise(F.concat(cut, F.lit("...")))


def important_tail(text: Column) -> Column:
    """Whether the last 2000 characters speak of errors or results or end in a closing brace."""
    tail = F.lower(F.right(text, F.lit(2000)))
    # Words that make the tail worth keeping.
    words = r"\b(error|exception|failed|fatal|traceback|panic|stack trace|errno|exit code|total|summary|result|complete|finished|done|conclusion)\b"
    return tail.rlike(words) | tail.rlike(r"(?U)\}\s*$")


# Lengths of the two notes that a cut text's budget is reduced by, and the second one.
NOTES = 62 + 63
CUT_NOTE = "\n[truncated: tool output exceeded budget, head+tail preserved]"


def truncate(text: Column, most: int) -> Column:
    """Head and tail of a text of more than most characters, cut at line ends that are near, with notes on what is missing."""
    budget = max(200, most - NOTES)
    size = F.char_length(text)

    def cut(s: Column) -> Column:
        gone = s["start"] - s["head"]
        note = F.concat(F.lit("\n\n⚠️ [... "), gone.cast("string"), F.lit(" chars / ~"), F.floor(gone / 4 + F.lit(0.5)).cast("string"), F.lit(" tokens omitted — showing head and tail ...]\n\n"))
        return F.concat(F.substring(text, F.lit(1), s["head"]), note, F.substring(text, s["start"] + 1, size), F.lit(CUT_NOTE))

    def ends(counts: Column) -> Column:
        head, tail = (F.when(counts, int(budget * a)).otherwise(int(budget * b)) for a, b in ((0.6, 0.8), (0.3, 0.1)))
        before, after = F.substring(text, F.lit(1), head + 1), F.right(text, tail)
        lines = F.struct((head + 1 - F.instr(F.reverse(before), "\n")).alias("last"), F.instr(after, "\n").alias("first"), head.alias("h"), tail.alias("t"))
        head_cut = lambda s: F.when((s["last"] <= s["h"]) & (s["last"] > s["h"] * F.lit(0.8)), s["last"]).otherwise(s["h"])
        start = lambda s: size - s["t"] + F.when((s["first"] > 0) & (s["first"] - 1 < s["t"] * F.lit(0.2)), s["first"]).otherwise(0)
        return let(lines, lambda s: F.struct(head_cut(s).alias("head"), start(s).alias("start")))

    return F.when(size <= most, text).otherwise(let(let(important_tail(text), ends), cut))


def truncate_by_tokens(text: Column, most: int) -> Column:
    """The first six and last three tenths of 4 * most characters of a longer text."""
    chars = most * 4
    head, tail = int(chars * 0.6), int(chars * 0.3)
    gone = F.char_length(text) - head - tail
    note = F.concat(F.lit("\n\n... ["), gone.cast("string"), F.lit(" chars omitted, ~"), F.floor(gone / 4 + F.lit(0.5)).cast("string"), F.lit(" tokens] ...\n\n"))
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def trim_message(role: Column, text: Column, most: int = 800) -> Column:
    """A message for the context: users' without metadata, assistants' as they are, others cut if they have over most tokens."""
    return F.when(role == "user", strip_metadata(text)).when(role == "assistant", text).when(tokens(text) > most, truncate_by_tokens(text, most)).otherwise(text)


def first_sentence(text: Column) -> Column:
    return trim(F.element_at(F.split(text, r"[.!?。！？\n]"), 1))


def token_count_text(n: Column) -> Column:
    """1234567 as "1.2M", 1234 as "1.2K"; ties of the binary value go up."""
    tenths = lambda unit: F.floor(n * F.lit(10.0) / unit + F.lit(0.5)) / 10
    return F.when(n >= 1_000_000, F.concat(tenths(1_000_000).cast("decimal(20,1)").cast("string"), F.lit("M"))).when(n >= 1000, F.concat(tenths(1000).cast("decimal(20,1)").cast("string"), F.lit("K"))).otherwise(n.cast("string"))
