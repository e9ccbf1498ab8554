"""String functions over columns: prompts, conversations, tagged boxes, answers.  All are built-in expressions; nulls give null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System texts and conversation templates: name -> (system, human, assistant, style, sep, sep2) (fixed values).
CURIOUS = "A chat between a curious {0} and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the {0}'s questions."
VISUAL = (
    "You are LLaVA, a large language and vision assistant trained by UW Madison WAIV Lab."
    "You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
    "Follow the instructions carefully and explain your answers in detail."
)
TEMPLATES = {
    "default": (CURIOUS.format("human"), "Human", "Assistant", "single", "###", None),
    "simple": (CURIOUS.format("human"), "Human", "Assistant", "single", "###", None),
    "v1": (CURIOUS.format("human"), "Human", "Assistant", "single", "###", None),
    "multimodal": (VISUAL, "Human", "Assistant", "single", "###", None),
    "llava_v1": (VISUAL, "USER", "ASSISTANT", "two", " ", "</s>"),
    "bair_v1": ("BEGINNING OF CONVERSATION:", "USER", "GPT", "two", " ", "</s>"),
    "vicuna_v1_1": (CURIOUS.format("user"), "USER", "ASSISTANT", "two", " ", "</s>"),
}
#: Words of the counts that an enumeration prints.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def role(c: Column) -> Column:
    """0 for the human side, 1 for the assistant's; anything else is an error."""
    return (
        F.when(F.lower(c).isin("human", "user"), 0).when(F.lower(c).isin("gpt", "assistant"), 1).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(c, F.lit("null")))).cast("int"))
    )


def render_single(system: Column, turns: Column, human: str = "Human", assistant: str = "Assistant", sep: str = "###") -> Column:
    """A conversation in the single-separator style; a turn without text ends with its role, to be continued."""

    def one(t: Column) -> Column:
        who = F.when(t["role"] == 0, human).otherwise(assistant)
        said = t["text"].isNotNull() & (t["text"] != "")
        return F.when(said, F.concat(F.lit(" "), who, F.lit(": "), t["text"], F.lit("\n" + sep))).otherwise(F.concat(F.lit(" "), who, F.lit(":")))

    return F.concat(system, F.lit("\n\n" + sep), F.array_join(F.transform(turns, one), ""))


def render_two(system: Column, turns: Column, human: str = "USER", assistant: str = "ASSISTANT", sep: str = " ", sep2: str = "</s>") -> Column:
    """A conversation in the style whose separators alternate with the turns."""

    def one(t: Column, i: Column) -> Column:
        who = F.when(t["role"] == 0, human).otherwise(assistant)
        said = t["text"].isNotNull() & (t["text"] != "")
        return F.when(said, F.concat(F.lit(" "), who, F.lit(": "), t["text"], F.when(i % 2 == 0, sep).otherwise(sep2))).otherwise(F.concat(F.lit(" "), who, F.lit(":")))

    return F.concat(system, F.lit(sep), F.array_join(F.transform(turns, one), ""))


def render(template: str, turns: Column, system: Column | None = None) -> Column:
    """A conversation by the name of its template; the template's own system text where none is given."""
    own, human, assistant, style, sep, sep2 = TEMPLATES[template]
    system = F.coalesce(system, F.lit(own)) if system is not None else F.lit(own)
    return render_single(system, turns, human, assistant, sep) if style == "single" else render_two(system, turns, human, assistant, sep, sep2)


def targets(turns: Column, sep: str = "###") -> Column:
    """What a model has to predict: the assistant's texts with their separator."""
    return F.transform(F.filter(turns, lambda t: (t["role"] == 1) & t["text"].isNotNull()), lambda t: F.concat(t["text"], F.lit("\n" + sep)))


def alpaca_prompt(instruction: Column, context: Column) -> Column:
    """The instruction prompt; a blank context counts as none."""
    none = context.isNull() | (strip(context) == "")
    # the prompt's texts (fixed values)
    lead = "Below is an instruction that describes a task{}. Write a response that appropriately completes the request.\n\n### Instruction:\n"
    plain = F.concat(F.lit(lead.format("")), instruction, F.lit("\n\n### Response:"))
    full = F.concat(F.lit(lead.format(", paired with an input that provides further context")), instruction, F.lit("\n\n### Input:\n"), context, F.lit("\n\n### Response:"))
    return F.when(none, plain).otherwise(full)


def prompt(kind: str, instruction: Column, context: Column | None = None) -> Column:
    """A prompt by kind: alpaca, shortqa, qg (a question for an answer), caption (nothing) or plain (the instruction itself)."""
    # the prompts' texts (fixed values)
    if kind == "shortqa":
        lead = "Below is an instruction that describes a task. Write a response that appropriately completes the request using a single word or phrase.\n\n### Instruction:\n"
        return F.concat(F.lit(lead), instruction, F.lit("\n\n### Response:"))
    if kind == "qg":
        return F.concat(F.lit("Generate a question whose answer is:\n"), instruction, F.lit("\n\nQuestion:\n"))
    if kind == "alpaca":
        return alpaca_prompt(instruction, context if context is not None else F.lit(None).cast("string"))
    if kind == "caption":
        return F.lit("")
    if kind == "plain":
        return instruction
    raise ValueError(f"unknown prompt kind {kind!r}")


def drop_image_tag(c: Column) -> Column:
    return strip(F.replace(c, F.lit("<image>"), F.lit("")))


def tagged_boxes(c: Column) -> Column:
    """array<struct<name,values>> of <tag>name</tag>[numbers]; the first four above 1 are hundredths, -10000 is null."""
    pattern = r"<(\w+)>([^<]+)</\1>\[([\d.,-]+)\]"
    number = lambda v, i: F.when(v == -10000, None).when((i < 4) & (v > 1), v / 100).otherwise(v)
    values = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(3)), lambda s: F.transform(F.transform(F.split(s, ","), lambda x: x.try_cast("double")), number))
    return F.zip_with(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), values, lambda n, v: F.struct(n.alias("name"), v.alias("values")))


def box_texts(c: Column) -> Column:
    """array<string> of <box>..</box>[[i,i,i],..]: each box's corners as they stand."""
    return F.regexp_extract_all(c, F.lit(r"<box>(.*?)</box>\[(\[[\d,]+?\](?:,\[[\d,]+?\])*)\]"), F.lit(2))


def corner_numbers(box: Column) -> Column:
    """array<array<int>> of a box's text: the integers of each corner, those beyond an int null."""
    return F.transform(F.regexp_extract_all(box, F.lit(r"\[([\d,]+)\]"), F.lit(1)), lambda p: F.transform(F.split(p, ","), lambda x: x.try_cast("int")))


def corner_boxes(c: Column) -> Column:
    """array<array<array<double>>> of <box>..</box>[[i,i,i],..]: integers in hundredths."""
    return F.transform(box_texts(c), lambda b: F.transform(corner_numbers(b), lambda p: F.transform(p, lambda x: x / 100)))


def number_lists(c: Column, stride: int = 3) -> Column:
    """All bracketed numbers in order, cut into rows of ``stride`` (a short rest is dropped)."""
    flat = F.transform(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\[([-.\d,]+)\]"), F.lit(1)), lambda s: F.split(s, ","))), lambda x: x.try_cast("double"))
    n = F.floor(F.size(flat) / stride).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(flat, i * stride + 1, F.lit(stride)))).otherwise(F.array().cast("array<array<double>>"))


def fixed_numbers(c: Column, n: int) -> Column:
    """array<array<int>> of bracketed lists with exactly n integers."""
    pattern = r"\[(-?\d+(?:,-?\d+){%d})\]" % (n - 1)
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda x: x.cast("int")))


def normalise_answer(c: Column) -> Column:
    """Numbers of an answer: digits and commas stay, long runs get a point before the last three digits, magnitudes are scaled below 1."""
    kept = F.regexp_replace(c, r"[^\d,]", "")
    pointed = F.regexp_replace(kept, r"(\d+)(\d{3})(?!\d)", "$1.$2")
    values = F.transform(F.filter(F.split(pointed, ","), lambda x: x != ""), lambda x: x.cast("double"))
    return F.transform(values, lambda v: F.when(v > 100, v / 1000).when(v > 10, v / 100).when(v >= 1, v / 10).otherwise(v))


def trim_answer(c: Column, stop: str = "###") -> Column:
    """Up to the stop marker, without points, stripped; of 'answer is x' only x."""
    cut = strip(F.replace(F.substring_index(c, stop, 1), F.lit("."), F.lit("")))
    said = F.regexp_extract(cut, r"answer is (\S+)", 1)
    return F.when(said != "", said).otherwise(cut)


def format_centi(n: Column) -> Column:
    """Hundredths as text with two places."""
    whole = F.abs(n)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(whole / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def centi(x: Column) -> Column:
    """A number in whole hundredths, halves up."""
    return F.floor(x * 100 + 0.5).cast("bigint")


def format_boxes(boxes: Column) -> Column:
    """[x,y,..;x,y,..] of boxes in thousandths, three places."""
    one = lambda v: F.concat(F.floor(v / 1000).cast("bigint").cast("string"), F.lit("."), F.lpad((v % 1000).cast("string"), 3, "0"))
    return F.concat(F.lit("["), F.array_join(F.transform(boxes, lambda b: F.array_join(F.transform(b, one), ",")), ";"), F.lit("]"))


def extract_boxes(c: Column) -> Column:
    """array<array<double>>: the boxes of every bracket of numbers with one digit before the point."""
    found = F.regexp_extract_all(c, F.lit(r"\[(\d(?:\.\d*)?(?:[,;]\d(?:\.\d*)?)*)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(found, lambda s: F.split(s, ";"))), lambda b: F.transform(F.split(b, ","), lambda x: x.cast("double")))


def fill_placeholders(c: Column, values: Column, mark: str = "<boxes>") -> Column:
    """The n-th mark replaced by the n-th value; different counts are an error."""
    parts = F.split(c, mark)
    checked = F.when(F.size(parts) - 1 == F.size(values), values).otherwise(F.raise_error(F.lit("marks and values differ in number")).cast("array<string>"))
    return F.array_join(F.zip_with(parts, F.concat(checked, F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")


def after_marker(c: Column, marker: str) -> tuple[Column, Column]:
    """Text before and after the first marker (plain text, no pattern); both null where it is missing."""
    at = F.instr(c, F.lit(marker))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)), F.when(at > 0, F.substring(c, at + len(marker), F.length(c)))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template with each {NAME} replaced; values are taken as they are, even if they hold a name in braces."""
    import re

    unknown = set(re.findall(r"\{([A-Z_]+)\}", template)) - set(values)
    if unknown:
        raise ValueError(f"no value for {sorted(unknown)}")
    parts = re.split(r"\{([A-Z_]+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def rewritten(path: Column, parts: dict[str, str]) -> Column:
    """A path with parts of it replaced, one after another."""
    for old, new in parts.items():
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def repair_limits(line: Column) -> Column:
    """Joint limit lines get an effort and a velocity, and None becomes 0 on every line."""
    limit = F.ltrim(line).startswith("<limit") & ~(line.contains("effort=") & line.contains("velocity="))
    return F.replace(F.when(limit, F.replace(line, F.lit("<limit"), F.lit('<limit effort="30" velocity="1.0"'))).otherwise(line), F.lit("None"), F.lit("0"))


def strip_fence(c: Column) -> Column:
    """The inside of a fenced code block, or the text itself."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(c)


_QUOTED = r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""


def literal_list(c: Column) -> Column:
    """A list of quoted strings, in either quotes and with backslashes before quotes, as array<string>; what cannot be read is empty."""
    whole = rf"(?s)^\s*\[\s*(?:(?:{_QUOTED})\s*(?:,\s*(?:{_QUOTED})\s*)*,?\s*)?\]\s*$"
    items = F.regexp_extract_all(c, F.lit(f"(?s){_QUOTED}"), F.lit(0))
    plain = F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1"))
    return F.when(c.rlike(whole), plain).otherwise(F.array().cast("array<string>"))


def verb(action: Column) -> Column:
    return F.split(action, r"\[")[0]


def number_word(n: Column) -> Column:
    """The word of 1 to 11; other numbers are an error."""
    words = F.array(*map(F.lit, NUMBER_WORDS))
    return F.when(n.between(1, len(NUMBER_WORDS)), F.get(words, n.cast("int") - 1)).otherwise(F.raise_error(F.concat(F.lit("no word for "), n.cast("string"))).cast("string"))


def enumeration(names: Column) -> Column:
    """'There is one part: a.' or 'There are two parts: a,b.'"""
    n = F.size(names)
    lead = F.when(n == 1, F.lit("There is one part: ")).otherwise(F.concat(F.lit("There are "), number_word(n), F.lit(" parts: ")))
    return F.concat(lead, F.array_join(names, ","), F.lit("."))


def sanitise(c: Column) -> Column:
    """Identifiers for file names."""
    return F.translate(c, "/\\.?!", "-----")


def answer_kind(c: Column) -> Column:
    """0 text, 1 boxes, 2 boxes with an orientation tag."""
    return F.when(~c.contains("["), 0).when(~(c.contains("<rp>") | c.contains("<rb>")), 1).otherwise(2)


def valid_box(b: Column) -> Column:
    """Four numbers with ordered corners."""
    return F.coalesce((F.size(b) == 4) & (F.get(b, F.lit(0)) <= F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) <= F.get(b, F.lit(3))), F.lit(False))
