"""Column expressions on report texts: cleaning, canonical forms, validity, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# They decide which results are right.
ENTITY_TYPES = ("IP", "Domain", "URL", "File", "Email", "Type", "Device", "Vendor", "Version", "Software", "Function", "Platform", "Malware", "Vulnerability", "ThreatActor", "Other")
DENIED = {
    "Domain": ("localhost", "example.com", "test.com", "domain.com", "sample.com", "local", "corp", "internal"),
    "Email": ("user@example.com", "test@test.com", "admin@domain.com", "support@company.com"),
    "IP": ("127.0.0.1", "0.0.0.0", "255.255.255.255", "192.168.1.1", "10.0.0.1"),
    "File": ("file.exe", "sample.exe", "test.dll", "example.pdf", "document.doc"),
    "Type": ("other", "unknown", "various", "multiple", "different", "several"),
    "Device": ("system", "service", "application", "generic", "unknown"),
    "Platform": ("other", "unknown", "various", "multiple", "all", "any"),
    "Software": ("software", "application", "program", "tool", "unknown"),
    "Vendor": ("vendor", "company", "organization", "unknown", "various"),
    "Version": ("version", "unknown", "latest", "current", "old", "new"),
    "Function": ("function", "functionality", "feature", "capability", "unknown"),
    "Malware": ("malware", "sample", "unknown", "generic", "family"),
    "Vulnerability": ("vulnerability", "flaw", "weakness", "issue", "bug"),
    "ThreatActor": ("group", "actor", "unknown", "threat", "attacker", "hacker", "adversary", "various", "multiple", "unidentified"),
    "Other": ("hash", "value", "data", "information", "content"),
}
GENERIC = ("unknown", "various", "multiple", "different", "several", "other", "misc", "general")
GENERIC_ACTORS = ("the group", "threat actor", "hacking group", "unknown actor", "adversary")
EXTENSIONS = ("exe", "dll", "bat", "cmd", "scr", "vbs", "js", "jar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "sys", "bin", "so", "dylib")
DIGEST_LENGTHS = (32, 40, 64, 128)
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by")
LOWERED = ("Type", "Device", "Platform", "Software", "Function")
KEYWORDS = {
    "IP": ("address", "server", "host", "endpoint", "connects", "communicates"),
    "Domain": ("domain", "hostname", "C2", "command", "control", "queries"),
    "File": ("file", "executable", "drops", "creates", "writes", "payload"),
    "Type": ("malware", "attack", "threat", "campaign"),
    "Device": ("device", "system", "machine", "endpoint", "server"),
    "Platform": ("Windows", "Linux", "Android", "iOS", "platform"),
    "Malware": ("malware", "trojan", "backdoor", "ransomware", "virus"),
    "Vulnerability": ("CVE", "vulnerability", "exploit", "flaw", "weakness"),
    "ThreatActor": ("APT", "group", "actor", "attributed", "campaign", "threat", "nation-state", "espionage"),
}
HEDGES = ("likely", "possibly", "probably", "may", "might", "could", "suspected", "believed", "allegedly")
PROBABLE = ("likely", "probably")
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "unable", "failed", "doesn't", "don't")
DOMAIN_SHAPE = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
# End of the fixed values.


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def spaced(c: Column) -> Column:
    """Runs of white space made one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def canonical(text: Column, kind: Column, actors: bool = True, keep_null_word: bool = True) -> Column:
    """Canonical form of an entity by its type: the key by which mentions are one node."""
    cve = stripped(F.upper(text))
    parts = r"^CVE[- ]?(\d{4})[- ]?(\d+)"
    forms = F.when(kind == "Vulnerability", F.when(cve.rlike(parts), F.concat(F.lit("CVE-"), F.regexp_extract(cve, parts, 1), F.lit("-"), F.regexp_extract(cve, parts, 2))).otherwise(cve))
    forms = forms.when(kind.contains("Hash") | (kind == "File"), F.replace(stripped(F.lower(text)), F.lit(" "), F.lit("")))
    forms = forms.when(kind == "IP", F.rtrim(stripped(text), F.lit(".")))
    forms = forms.when(kind == "Domain", F.rtrim(stripped(F.lower(text)), F.lit(".,")))
    forms = forms.when(kind == "URL", F.rtrim(stripped(text), F.lit(",")))
    if actors:
        forms = forms.when(kind == "ThreatActor", spaced(stripped(F.lower(text))))
    forms = forms.otherwise(stripped(text))
    return F.when(text.isNull() | (text == "") | (text == "NULL"), text).otherwise(forms) if keep_null_word else forms


def cleaned(value: Column, kind: str) -> Column:
    """An extracted value tidied by its type."""
    v = spaced(stripped(value))
    if kind == "Domain":
        return F.rtrim(F.regexp_replace(F.regexp_replace(v, "^https?://", ""), "^ftp://", ""), F.lit("/"))
    if kind == "IP":
        return F.btrim(v, F.lit("[](){}<>"))
    if kind == "File":
        return F.when(v.contains("\\"), F.element_at(F.split(v, r"\\"), -1)).otherwise(F.element_at(F.split(v, "/"), -1))
    if kind in LOWERED:
        return stripped(F.regexp_replace(F.lower(v), rf"(?U)\b(?:{'|'.join(STOP_WORDS)})\b\s*", ""))
    return v


def valid(value: Column, kind: str) -> Column:
    """Whether a tidied value may stand as an entity of its type."""
    low = F.lower(value)
    ok = (F.char_length(stripped(value)) >= 2) & ~low.isin(*{x.lower() for x in DENIED.get(kind, ())}, *GENERIC)
    if kind == "Domain":
        return ok & value.rlike(DOMAIN_SHAPE) & ~low.isin("localhost", "local", "localdomain", "internal")
    if kind == "IP":
        parts = F.split(value, r"\.")
        number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
        ranges = number(1).between(0, 255) & number(2).between(0, 255) & number(3).between(0, 255) & number(4).between(0, 255)
        special = number(1).isin(0, 127, 255) | ((number(1) == 192) & (number(2) == 168))
        return ok & F.coalesce(value.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ranges & ~special, F.lit(False))
    if kind == "Email":
        return ok & value.rlike(r"^[^@]+@[^@]*\.[^@]*$")
    if kind == "File":
        return ok & value.contains(".") & F.lower(F.element_at(F.split(value, r"\."), -1)).isin(*EXTENSIONS)
    if kind == "Other":
        return ok & (~value.rlike("^[a-fA-F0-9]+$") | F.char_length(value).isin(*DIGEST_LENGTHS))
    if kind == "ThreatActor":
        return ok & (F.char_length(value) >= 3) & value.rlike(r"^\p{Lu}|APT|FIN|TA|UNC") & ~low.isin(*GENERIC_ACTORS)
    return ok


def low_quality(text: Column) -> Column:
    """Fewer than 0.7 of the characters are letters, or there are none."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.char_length(text) == 0) | (letters / F.char_length(text) < 0.7)


def certainty(text: Column) -> Column:
    """By the first hedging word, in the words' order, that the text contains anywhere."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for word in HEDGES:
        level = F.lit("probable" if word in PROBABLE else "possible")
        out = F.when(low.contains(word), level) if out is None else out.when(low.contains(word), level)
    return out.otherwise("confirmed")


def negated(text: Column, whole_words: bool = False) -> Column:
    """Whether a negation occurs, within words too unless whole_words is set."""
    low = F.lower(F.coalesce(text, F.lit("")))
    either = "|".join(NEGATIONS)
    return low.rlike(rf"(?U)\b(?:{either})\b" if whole_words else either)


def keyword_hits(text: Column, kind: str) -> Column:
    low = F.lower(text)
    return sum((low.contains(w.lower()).cast("int") for w in KEYWORDS.get(kind, ())), F.lit(0))
