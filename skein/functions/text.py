"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"

# Phrases and words of the retrieval policy.
CITATION_WORDS = ("usc", "u.s.c", "section")
OMISSIONS = (
    "skip citation", "skip citations", "no citation needed", "no citations needed", "no need to cite", "without citation", "without citations", "without citing",
    "don't bother citing", "no reference needed", "skip the reference", "no official source",
)
OMISSIONS_CJK = ("省略", "省略掉", "忽略", "不算", "不必引用", "不用引用", "不要引用", "不必查", "不用查", "不用检索", "不需要引文", "不要引文", "不要出处", "不需要出处")
FOLLOW_UPS = (
    "what about the exception", "what about exceptions", "what about the exemption", "what about the rule", "what about the regulation", "and the exception", "any exceptions", "any exemption",
)
FOLLOW_UPS_CJK = (
    "那例外呢", "那例外的呢", "那豁免呢", "那豁免情况呢", "那规则呢", "那规章呢", "那这条呢", "还有例外吗", "有例外吗", "有豁免吗", "那怎么办", "那怎么处理", "这种情况呢", "那种情况呢", "那如果", "如果是这种情况", "如果我",
)
REGULATORY = (
    "regulation", "regulations", "rule", "rules", "cfr", "ecfr", "federal register", "statute", "statutes", "law", "legal", "compliance", "requirement", "requirements", "exemption", "exception", "permit",
    "citation", "cite", "reference", "section", "policy", "policies", "guideline", "guidelines",
)
REGULATORY_CJK = (
    "法规", "规章", "规则", "条例", "法律", "法定", "合规", "遵约", "要求", "条款", "条文", "豁免", "例外", "许可", "许可证", "引用", "出处", "依据", "管辖", "标准", "排放", "污染物", "危险品", "化学品", "安全", "监管",
)
ARTIFACTS = (
    ".py", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".go", ".rs", ".java", ".ts", ".tsx", ".js", ".jsx", "cmake", "makefile", "conanfile", "toml", "yaml", "yml", "json", "cargo", "mvn ", "gradle", "pip ", "pytest",
)
ARTIFACT_WORDS = ("function", "class", "method", "compile", "build", "test", "debug")
OPT_OUTS = ("不要使用记忆", "不要参考记忆", "别参考历史", "忽略之前的记忆", "do not use memory", "don't use memory", "ignore previous memory", "ignore memories")
RETRIEVAL_OPT_OUTS = ("do not use rag", "don't use rag", "do not use the knowledge base", "don't use the knowledge base")
RETRIEVAL_OPT_OUTS_CJK = ("不要查询知识库", "不要使用知识库", "不要用知识库", "不要用 rag", "不要用rag", "不使用 rag", "不使用rag")


def ascii_lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, UPPER, LOWER)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_body(c: Column) -> Column:
    """LF line ends, lines without outer spaces, one blank line at most between others, none at the end."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\n+\z", "")


def heading(c: Column, number: Column) -> Column:
    """A section's heading without its number and final stop."""
    return F.rtrim(F.regexp_replace(F.when(F.startswith(c, F.concat(F.lit("§ "), number)), F.substr(c, F.length(number) + 3)).otherwise(c), r"^\s+|\.\s*$", ""))


def path_component(c: Column) -> Column:
    """Safe as a file name, 48 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 48)


def contains_word(c: Column, word: str) -> Column:
    """The word, or phrase, without an ASCII letter or digit at either end. The column is lower case."""
    return c.rlike(r"(^|[^A-Za-z0-9])" + word.replace(".", r"\.") + r"([^A-Za-z0-9]|$)")


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def tokens(c: Column) -> Column:
    """Search terms, a bag: ASCII identifiers, their snake and camel parts where these differ, CJK characters and pairs of neighbours, other letters and digits.

    Text should be in NFKC form; folding is lower case with ß as ss.
    """
    fold = lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), 0)
    words = F.transform(found, F.lower)
    # what follows is looked for only in texts that have it
    compound = "_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
    parts = lambda w: F.flatten(F.transform(F.split(w, "_"), lambda p: F.split(p, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")))
    inner = F.flatten(F.transform(F.filter(found, lambda w: w.rlike(compound)), lambda w: F.filter(F.transform(parts(w), F.lower), lambda p: (p != "") & (p != F.lower(w)))))
    inner = F.when(c.rlike(compound), inner).otherwise(none)
    runs = F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), 0)
    single = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("(?s)."), 0)))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(none)))
    cjk = F.when(has_cjk(c), F.concat(single, pairs)).otherwise(none)
    others = F.transform(F.regexp_extract_all(c, F.lit(rf"[\p{{L}}\p{{N}}&&[^A-Za-z0-9{CJK}]]+"), 0), fold)
    return F.concat(words, inner, cjk, others)


def memory_tokens(c: Column) -> Column:
    """Distinct terms for recall of memories: lower-case ASCII words, and any other character that isn't white or punctuation."""
    rest = F.regexp_replace(c, r"[A-Za-z0-9]+", " ")
    pairs = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(f"[{CJK}]+"), 0), lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+"), 0), F.lower), F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}]"), 0), pairs))


def citations(c: Column) -> Column:
    """Distinct references such as `40 cfr 60.1`, in order."""
    pattern = r"(?i)\b[0-9]{1,2}\s*cfr\s*(?:(?:section|sec\.?|§)\s*)?[0-9]+(?:\.[0-9a-z_-]+)*"
    section = F.lit(r"([0-9]+(?:\.[0-9a-z_-]+)*)$")
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), F.lower)
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.regexp_extract(x, "^0*([0-9]+)", 1), F.lit(" cfr "), F.regexp_substr(x, section))))


def holds_any(c: Column, phrases) -> Column:
    """Whether any phrase stands in the text, whatever the case of A-Z: one pass, which looks no further where none of their first characters is."""
    firsts = "".join(sorted({re.escape(p[0]) for p in phrases}))
    return c.rlike(f"(?i)(?=[{firsts}])(?:" + "|".join(re.escape(p) for p in phrases) + ")")


def holds_word(c: Column, words) -> Column:
    """The same for words, or phrases, without an ASCII letter or digit at either end."""
    firsts = "".join(sorted({w[0] for w in words}))
    return c.rlike(f"(?i)(?=[{firsts}])(?<![A-Za-z0-9])(?:" + "|".join(re.escape(w) for w in words) + ")(?![A-Za-z0-9])")


def retrieval_need(c: Column, policy: Column | None = None, carried: Column | None = None) -> Column:
    """struct(need, reason). policy is off, auto or always; carried: the session has needed retrieval before."""
    policy, carried = F.lit("auto") if policy is None else policy, F.lit(False) if carried is None else carried
    chinese = c.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]")
    either = lambda in_chinese, in_english: F.when(chinese, in_chinese).otherwise(in_english)
    flags = F.struct(
        chinese.alias("cjk"),
        (c.rlike(r"(?i)(?<![0-9])cfr(?![0-9])") | holds_word(c, CITATION_WORDS)).alias("cites"),
        either(holds_any(c, OMISSIONS_CJK), holds_any(c, OMISSIONS)).alias("omits"),
        either(holds_any(c, FOLLOW_UPS_CJK), holds_any(c, FOLLOW_UPS)).alias("follows"),
        either(holds_any(c, REGULATORY_CJK), holds_word(c, REGULATORY)).alias("words"),
    )
    code = holds_any(c, ARTIFACTS) | holds_word(c, ARTIFACT_WORDS)
    out = lambda need, reason: F.struct(F.lit(need).alias("need"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    def decided(f: Column) -> Column:
        ordinary = F.when(f["cjk"], F.lit("no_regulatory_signal_cjk")).otherwise(F.lit("no_regulatory_signal_en"))
        return (
            F.when(policy == "off", out("none", "user_opted_out"))
            .when((policy == "always") & f["cites"], out("exact", "user_explicit_always"))
            .when(policy == "always", out("semantic", "user_explicit_always"))
            .when(carried & ~(f["cites"] | f["omits"] | f["follows"] | f["words"]), out("semantic", "session_always_required"))
            .when(f["cites"], out("exact", "regulatory_citation"))
            .when(f["follows"], out("semantic", "regulatory_followup"))
            .when(f["omits"], out("semantic", "regulatory_omission"))
            .when(f["words"] & code, out("semantic", "regulatory_code_mixed_question"))
            .when(f["words"], out("semantic", ordinary))
            .otherwise(out("none", ordinary))
        )

    return F.transform(F.array(flags), decided)[0]  # the flags are found once for each text, not once for each branch


def looks_sensitive(c: Column) -> Column:
    """Keys, bearer tokens, assigned passwords and secrets (but rules about passwords in prose), private keys."""
    low = ascii_lower(c)
    names = r"(^|[^a-z0-9_-])(password|secret|api-key|api_key|apikey)['\"]?\s*"
    prose = r":\s*((should|must)\b.*\b(length|characters?|phrase|passphrase)\b|recommended\b.*\blength\b|use\b.*\bat\b.*\bleast\b.*\b(length|characters?|phrase|passphrase)\b|prefer\b.*\blong\b.*\b(phrase|passphrase)\b)"
    colon = low.rlike(names + r":\s*(\S\s*){4}") & ~low.rlike(r"(?s)(password|secret|api-key|api_key|apikey)['\"]?\s*" + prose)
    return low.rlike(r"sk[-_][a-z0-9_-]{16}") | low.rlike(r"(^|[^a-z0-9_-])bearer\s+[a-z0-9_-]{12}") | low.rlike(names + r"=\s*\S{4}") | colon | (low.contains("-----begin ") & low.contains(" private key-----"))


def dangerous(tool: Column, payload: Column) -> Column:
    """The first dangerous pattern in a call, or null."""
    call = F.concat(ascii_lower(tool), F.lit("\n"), ascii_lower(F.replace(payload, F.lit("\\"), F.lit("/"))))
    rooted = lambda x: call.rlike(rf'(^|[ "\n\r])(/|~/|[a-z]:/)[^ "\n\r]*{x}|(^|[ "\n\r]){x}' if x.startswith("/") else rf'(^|[ "\n\r])(/|~/|[a-z]:/)[^ "\n\r]*{x}')
    return (
        F.when(rooted(r"\.ssh/"), "ssh_keys")
        .when(rooted(r"\.aws/"), "aws_creds")
        .when(call.contains("rm -rf"), "destructive")
        .when(call.contains("curl"), "curl_pipe_sh")
        .when(rooted("/etc/"), "host_etc")
    )


def memory_opted_out(c: Column) -> Column:
    return holds_any(c, OPT_OUTS)


def retrieval_opted_out(c: Column) -> Column:
    """Whether nothing is looked up for a text: a command, whose first character but for white space is a slash, or one that says so. Null for null."""
    return c.rlike(r"\A[ \t\r\n]*/") | holds_any(c, (*RETRIEVAL_OPT_OUTS, *RETRIEVAL_OPT_OUTS_CJK))


def strip_front_matter(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\A---\n(?:.*\n)*?---\n", ""))


def valid_timestamp(c: Column) -> Column:
    """UTC in ISO form with seconds, or milliseconds, that is on the calendar."""
    return c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?Z$") & F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def normal_timestamp(c: Column) -> Column:
    return F.when(F.length(c) == 20, F.concat(F.substring(c, 1, 19), F.lit(".000Z"))).otherwise(c)


def literal_count(c: Column, needle: str) -> Column:
    """Places of a literal, counted from the left without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def literal_positions(c: Column, needle: str) -> Column:
    """Their columns from 1, in characters."""
    pieces = F.split(c, rf"\Q{needle}\E", -1)
    starts = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + len(needle)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")),
    )
    return starts["out"]
