"""Credentials embedded in source code and configuration: found with their place, and masked in place."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.config_formats import enclosing, holder, settings
from weftline.llm.yaml_tokens import Scalar
from weftline.session import spread
from weftline.sources.tables import table

#: What a masked value becomes.
MASK = "REDACTED"

# Words of key names, placeholders and token forms.
PASS_WORDS = {"password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "passwort", "contrasena"}
TOKEN_WORDS = {"token", "secret", "secrets", "credential", "credentials", "creds", "auth", "pat", "apikey", "apitoken", "authtoken", "accesskey", "secretkey", "jwt", "authorization"}
KEY_KINDS = {"api", "access", "secret", "private", "account", "signing", "encryption", "deploy", "storage", "auth", "master", "service", "client", "shared", "license", "webhook", "write", "admin", "sas"}
#: Keys that name the value of the key above them, and words of keys that tell it is something else. Fixed values.
VALUE_KEYS = {"value", "default", "data", "current", "content", "literal", "plain", "text", "raw", "string"}
OTHER_WORDS = {
    "user", "username", "login", "name", "id", "type", "kind", "method", "mode", "url", "uri", "host", "hostname", "server", "endpoint", "registry", "domain", "email", "mail", "path", "file", "filename", "dir", "folder", "scope", "scopes",
    "audience", "role", "region", "version", "algorithm", "alg", "issuer", "provider", "description", "format", "prefix", "suffix", "header", "comment", "note", "label", "image", "ref", "branch", "tag", "date", "expires", "created", "updated", "sha", "hash",
    "digest", "fingerprint", "checksum", "public", "cert", "certificate", "port", "uses", "run", "if", "on", "steps", "needs", "strategy", "matrix", "container", "services", "outputs", "concurrency", "permissions", "defaults", "required", "length", "ttl", "group",
    "environment", "jobs", "schedule", "cron", "shell", "timeout", "with", "env", "args", "command", "entrypoint", "options", "account", "project", "tenant", "team", "org", "organization", "owner", "repo", "repository",
}
#: Keys whose own keys are names given to things, not to values. Fixed values.
NAMING_KEYS = {"jobs", "services", "outputs", "inputs", "secrets", "groups", "matrix", "anchors"}
TRAILING_WORDS = {"base64", "b64", "prod", "dev", "test", "staging", "value", "old", "new", "ci", "text", "plain", "string", "literal", "default"}
PLACEHOLDER = re.compile(
    r"(?i)example|change[-_ ]?(?:me|it|this)|dummy|placeholder|redacted|masked|hidden|sample|(?:^|[-_ ])(?:your|insert|replace|todo|fixme|tbd|fill)(?:$|[-_ ])|replaceme|^(?:none|null|nil|undefined|unset|true|false|yes|no|on|off|empty|default|required|optional|inherit|disabled|enabled|password|passwd|secret|token|pass|n/a)$"
)
TOKEN_FORMS = (
    r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])", r"gh[opusr]_[A-Za-z0-9]{30,}", r"github_pat_\w{30,}", r"gl(?:pat|dt|rt|ptt|soat)-[\w-]{16,}", r"xox[abeoprs]-[\w-]{10,}", r"xapp-[\w-]{20,}",
    r"[srp]k_(?:live|test|prod)_[A-Za-z0-9]{16,}", r"whsec_[A-Za-z0-9+/=]{16,}", r"npm_[A-Za-z0-9]{30,}", r"pypi-[\w-]{16,}", r"AIza[\w-]{30,}", r"ya29\.[\w-]{20,}", r"eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}", r"SG\.[\w-]{16,}\.[\w-]{16,}",
    r"hf_[A-Za-z0-9]{30,}", r"dckr_pat_[\w-]{20,}", r"do[opr]_v1_[0-9a-f]{40,}", r"AGE-SECRET-KEY-[0-9A-Z]{20,}", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", r"sq0(?:atp|csp)-[\w-]{20,}", r"hv[sb]\.[\w-]{20,}", r"lin_api_\w{30,}", r"rubygems_[0-9a-f]{40,}", r"dapi[0-9a-f]{32}",
)


class Finding(NamedTuple):
    """text[start:end] is the secret; kind says by what it was found."""

    start: int
    end: int
    kind: str


_FORM = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(TOKEN_FORMS) + ")")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{20,}")
_BODY_PART = re.compile(r"\\[rn]|[^\s\\\"'#]+")
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:([^\s:/@\"'<>${}]*)(:))?((?:\$\{\{.*?\}\}|[^\s/\"'])+?)@(?=[A-Za-z0-9\[$<{])")
_HOOK = re.compile(r"https?://[^\s/\"'@]*(?:hook|logic\.azure)[^\s/\"'@]*/[^\s\"'<>]*|https?://[^\s/\"'@]+/[^\s\"'<>]*webhooks?/[^\s\"'<>]*")
_QUERY = re.compile(r"(?i)[?&;](?:[\w-]*(?:key|token|secret|signature|password|passwd|auth|sig|pwd|code)|sv_sig)=([^&\s\"'<>#;]{8,})")
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token|apikey)\s+[\"']?([^\s\"'\\,;<>]{8,})")
# key, operator and the rest: after a quote up to its end, else up to a blank or what ends a word there
_ASSIGN = re.compile(r"(?<![\w$%{.\-])(?:--?D?|-P|[$]env:)?[\"']?([A-Za-z_][\w.\-]*?)[\"']?[ \t]*(:=|=>|==|[:=])(?=[ \t\"'\S])[ \t]*")
_OPTION = re.compile(r"(?<!\S)--?([A-Za-z][\w-]*)[ \t]+(?=\S)")
_LOGIN_TOOL = re.compile(r"\b(?:docker|podman|helm|buildah|skopeo|oras|crane|nerdctl|az|oc|cf|vault|npm|twine|registry|heroku)\b")
_LOGIN_WORD = re.compile(r"\blogin\b")
_LOGIN_FLAG = re.compile(r"(?<!\S)(?:-p|--password|--pass|-P)[ =]\s*")
_SSHPASS = re.compile(r"\bsshpass\s+-p\s*")
_PART = re.compile(r"[^|;]+")  # of a line of commands
_MYSQL_TOOL, _MYSQL_FLAG = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b"), re.compile(r"\s-p(?=[^\s-])")
_FETCH_TOOL, _FETCH_FLAG = re.compile(r"\b(?:curl|wget|https?)\b"), re.compile(r"(?:\s-u|\s--user|\s-U|\s--proxy-user|\s-a)[ =]?[\"']?([^\s:\"']+):")
_NETRC = re.compile(r"(?:^|\s)(?:password|passwd)\s+(?=\S)")
_CALL = re.compile(r"(?i)\b(?:add_?password|set_?password|basic_?auth|with_?credentials|httpbasicauth|login|authenticate)\s*\((.*)")
_LAST_ARG = re.compile(r"([\"'])((?:(?!\1)[^\\]|\\.)*)\1\s*\)")
_XML = re.compile(r"(?i)<((?:[\w.\-]*)(?:password|passphrase|passwd|token|secret|apikey|accesskey|privatekey))>([^<>\s]+)</\1>")
_SAID = re.compile(r"(?i)\b(?:token|password|passwd|secret|api[-_ ]?key|credentials?|passphrase)\b[^\n]{0,60}?[:=][ \t]*[\"']?([A-Za-z0-9_+/=\-.]{16,})[\"']?[ \t]*$")
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.|'')*)'")
_ESCAPED = re.compile(r"\\\"((?:[^\"\\])*)\\\"")
_CALL_OUT = re.compile(r"^(?:\$|%\w+%$|%\(|\{\{|\{%|`|@\{|\$\{|#\{)|\$\{|\$\(|\{\{|<%|^\w+://\S*|^(?:vault|op|ssm|arn|secret|secrets|env|file|aws|gcp|azure|keyvault|sops|ref|pass|bw)[:+.]|^\.{1,2}/|^~/")
_BLANKED = re.compile(r"^[\W_]*$|^(.)\1*$|^[xX*.\-_#]+$|^<.*>$|^\[.*\]$|^\(.*\)$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_KEY_LINE = re.compile(r"[ \t]*(?:- +)*[\"']?[\w.\-]+[\"']?[ \t]*:(?:[ \t]|$)")
_BLANKS = re.compile(r"[ \t]*")
_MARKED = re.compile(r"[&!][^\s\"']*[ \t]+")
_VALUE_LINE = re.compile(r"(?:[ \t]*\r?\n)*([ ]*)([^\n]*)")
_WORDS = re.compile(r"(?:(?<![A-Za-z])b|B)64(?!\d)|[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BLOCK = re.compile(r"(?m)^([ \t]*(?:- +)*)[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*:[ \t]*(?:[&!]\S+[ \t]+)*(?:[|>][+\-0-9]*)?[ \t]*(?:#[^\n]*)?\r?\n")
_NAMED = re.compile(r"(?m)^([ \t]*)- +(?:name|key)[ \t]*:[ \t]*[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*\r?\n\1  value[ \t]*:[ \t]*")
_LINE_PART = re.compile(r"[^\s](?:[^\r\n]*[^\s])?")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_.~\-]{16,}={0,2}")
_WRAPPED_END = re.compile(r"[A-Za-z0-9+/_.~\-]+={0,2}|={1,2}")
#: In a line, the last two words of what may be a key or a section, and the names that stand beside values.
_KEYS = re.compile(r"(?<![\w.\-])((?:[\w.\-]++ ++)?[\w.\-]++)[\"']?\s*(?:[:=\]]|$)|\?[ \t]+[\"']?([\w.\- ]+)")
_BESIDE = re.compile(r"\b(?:name|key)[\"']?[ \t]*:\s*(?:[&!]\S+[ \t]+)*[\"']?((?:[\w.\-]+ *)+)")
_COMPACT = re.compile(r"[A-Za-z0-9_+/=!@#$%^&*~.\-]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
#: Keys of key stores, whose values are credentials where they are base64 of some length.
_STORE = re.compile(r"(?i)key[-_]?store(?:[-_]?(?:base64|b64))?$")
_STORED = re.compile(r"[A-Za-z0-9+/]{64,}={0,2}")
_CONSTANT = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
#: A line without any of these, in lower case and without _ and -, holds no finding but a token form; a
#: line without any of the others holds no token form. Every pattern requires one. Fixed values.
_HINTS = ("pass", "pwd", "pw", "phrase", "contrasena", "secret", "token", "key", "cred", "auth", "bearer", "basic", "login", "pat", "jwt", "://", "hook", "curl", "wget", "http", "mysql", "mariadb")
_SCHEMES = ("bearer", "basic", "token", "apikey")
_FORM_HINTS = (
    "AKIA", "ASIA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "glptt-", "glsoat-", "xox", "xapp-", "k_live_", "k_test_", "k_prod_", "whsec_", "npm_", "pypi-", "AIza", "ya29.",
    "eyJ", "SG.", "hf_", "dckr_pat_", "_v1_", "AGE-SECRET-KEY-", "shp", "sq0", "hvs.", "hvb.", "lin_api_", "rubygems_", "dapi",
)


@lru_cache(10_000)
def sensitive(name: str) -> str | None:
    """`pass`, `token` or `login` for the name of a key that holds a credential."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while len(words) > 1 and (words[-1] in TRAILING_WORDS or words[-1].isdigit()):
        words.pop()
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in PASS_WORDS or (last == "phrase" and before in ("pass", "unlock", "secret", "key", "seed")):
        return "pass"
    if last in TOKEN_WORDS or last in ("key", "keys") and before in KEY_KINDS:
        return "token"
    if last == "id" and words[-3:-1] == ["access", "key"]:
        return "token"
    joined = name.lower().replace("_", "").replace("-", "")
    if joined.endswith(("password", "passwd", "passphrase")):
        return "pass"
    if joined.endswith(("apikey", "authtoken", "accesstoken", "accesskey", "secretkey", "accountkey", "privatekey")):
        return "token"
    return "login" if last == "login" else None


def literal(value: str) -> bool:
    """Whether a value is meant as it stands: no reference, no placeholder, not blanked."""
    if value.startswith("/") and not (len(value) >= 30 and "." not in value and all(any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper))):
        return False  # a path; base64 may begin with the same sign
    return len(value) >= 4 and not (_CALL_OUT.search(value) or _BLANKED.match(value) or PLACEHOLDER.search(value))


def _mixed(value: str) -> bool:
    """Whether a value has signs of two kinds among digits, lower and upper case."""
    return sum(any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper)) >= 2


def _random(value: str, least: int) -> bool:
    digits, lower, upper = (any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper))
    return len(value) >= least and not re.search(r"\s", value) and digits + lower + upper >= 2 and (digits or not value.isalpha() or len(value) >= 16)


def holds(value: str, kind: str) -> bool:
    """Whether the value of a key of this kind is a credential."""
    if not literal(value) or re.search(r"\s", value.strip()) and not (kind == "pass" and re.search(r"\d", value)):
        return False
    if kind == "pass":
        plain = value.isalpha() and (value.islower() or value.isupper() or value.istitle())
        return not plain and not re.fullmatch(r"[a-z_.\-]+", value)
    if kind == "login":
        return _random(value, 20) and re.fullmatch(r"[A-Za-z0-9_\-]+", value) is not None
    return not _UUID.match(value) and _random(value, 8) and not re.fullmatch(r"v?\d+(?:\.\d+)+[\w.\-]*|\d+", value)


def _value(line: str, at: int, stops: str) -> tuple[int, int]:
    """The place of the value that begins at `at`: inside its quotes, or up to a blank or one of `stops`."""
    if m := _ESCAPED.match(line, at):
        return m.span(1)
    if m := _QUOTED.match(line, at):
        return m.span(1) if m[1] is not None else m.span(2)
    end = at
    while end < len(line) and line[end] not in stops:
        if line.startswith(("${{", "{{"), end):
            closing = line.find("}}", end)
            end = closing + 2 if closing >= 0 else len(line)
        else:
            end += 1
    return at, end


def _flag(line: str, tool: re.Pattern, flag: re.Pattern) -> re.Match | None:
    """The first flag behind its tool in the same part of a line of commands."""
    for part in _PART.finditer(line):
        if (m := tool.search(line, part.start(), part.end())) and (found := flag.search(line, m.end(), part.end())):
            return found
    return None


def _after_login(line: str) -> re.Match | None:
    """The first flag with a password behind the last login, of a tool named before it, that any such flag follows."""
    tool = _LOGIN_TOOL.search(line)
    flags = list(_LOGIN_FLAG.finditer(line, tool.end())) if tool else []
    logins = [m.end() for m in _LOGIN_WORD.finditer(line, tool.end()) if m.end() <= flags[-1].start()] if flags else []
    return next((f for f in flags if f.start() >= logins[-1]), None) if logins else None


def _in_line(line: str, low: str) -> Iterator[Finding]:
    stripped = line.lstrip()
    url = "://" in line
    for m in _USERINFO.finditer(line) if url and "@" in line else ():
        user, secret = m[1], m[3]
        if m[2]:
            if literal(secret) and not secret.isdigit() or secret.isdigit() and len(secret) > 5:
                yield Finding(m.start(3), m.end(3), "url")
        elif user is None and _random(secret, 20) and literal(secret) and re.search(r"\d", secret) and ":" not in secret:
            yield Finding(m.start(3), m.end(3), "url")
    for m in _HOOK.finditer(line) if url and ("hook" in low or "logic.azure" in low) else ():
        path = m[0].split("/", 3)[-1]
        parts = [p for p in re.split(r"[/?&=]", path) if _random(p, 16) and literal(p) and not _UUID.match(p)]
        if parts:
            at = line.index(parts[-1], m.start())
            yield Finding(at, at + len(parts[-1]), "url")
    for m in _QUERY.finditer(line) if url else ():
        if literal(m[1]) and _random(m[1], 12) and "://" in line[: m.start()]:
            yield Finding(*m.span(1), "url")
    if any(w in low for w in _SCHEMES):
        for m in _SCHEME.finditer(line):
            value = m[1]
            if literal(value) and (_random(value, 12) or _login(value)):
                yield Finding(*m.span(1), "header")
    whole_line = _KEY_LINE.match(line)
    value_at = -1 if whole_line is None else _BLANKS.match(line, whole_line.end()).end()  # of a key that begins its line
    reached = 0, ""  # the end of the last value and what ends such
    covered, dull = 0, set()  # up to where a credential reaches; ends of values that lack kinds of signs
    for m in _ASSIGN.finditer(line):
        kind = sensitive(m[1])
        if not kind or m.start() < covered:
            continue
        at = m.end()
        while tagged := _MARKED.match(line, at):
            at = tagged.end()
        yaml_value = m.end() == value_at
        stops = "\n" if yaml_value else " \t;,)}]&|<>\"'\\" if m[2] in ("=", "==") else " \t,;)}]\"'"
        if at < reached[0] and stops == reached[1] and line[at] not in "\"'\\":
            a, b = at, reached[0]  # inside a value that was read already
        else:
            a, b = _value(line, at, stops)
            if "{{" not in line:
                reached = b, stops
        value = line[a:b]
        if yaml_value and not (a > at):
            value = re.split(r"[ \t]+#", value, maxsplit=1)[0].rstrip()
        if m[2] == ":" and not yaml_value and line[m.end() - 1 : m.end()] == ":" and a == at and line[m.end() - 2 : m.end() - 1] not in ("'", '"'):
            continue  # a colon inside a word
        if kind != "pass" and b in dull:
            continue
        if holds(value, kind):
            covered = a + len(value)
            yield Finding(a, covered, "key name")
        elif kind != "pass" and not _mixed(value):
            dull.add(b)  # what ends there and begins later lacks them too
    for m in _OPTION.finditer(line) if "-" in line else ():
        if (kind := sensitive(m[1])) and m[1].lower() not in ("auth",):
            a, b = _value(line, m.end(), " \t;|&)")
            if holds(line[a:b], kind) and not line[a:b].startswith("-"):
                yield Finding(a, b, "command")
    for m in (_after_login(line) if "login" in line else None, _SSHPASS.search(line) if "sshpass" in line else None, _flag(line, _MYSQL_TOOL, _MYSQL_FLAG) if "m" in line else None):
        if m:
            a, b = _value(line, m.end(), " \t;|&)")
            if literal(line[a:b]):
                yield Finding(a, b, "command")
    if ("curl" in line or "wget" in line or "http" in line) and (m := _flag(line, _FETCH_TOOL, _FETCH_FLAG)):
        a, b = _value(line, m.end(), " \t;|\"'")
        if literal(line[a:b]) and literal(m[1] + "    ") and "//" not in m[1]:
            yield Finding(a, b, "command")
    if "passw" in line and (m := _NETRC.search(line)) and (stripped.startswith(("password", "passwd")) or re.search(r"\b(?:login|machine)\s+\S", line[: m.start() + 1])):
        a, b = _value(line, m.end(), " \t\\\"'")
        if holds(line[a:b], "pass") and line[a:b] not in ("is", "=", ":"):
            yield Finding(a, b, "netrc")
    if "(" in line and (m := _CALL.search(line)) and (last := _LAST_ARG.search(line, m.start(1))) and last.start() > m.start(1):
        if holds(last[2], "pass"):
            yield Finding(*last.span(2), "call")
    for m in _XML.finditer(line) if "</" in line else ():
        if holds(m[2], sensitive(m[1]) or "token"):
            yield Finding(*m.span(2), "key name")
    if ("#" in line or stripped.startswith("//")) and (m := _SAID.search(line)):
        if literal(m[1]) and _random(m[1], 16) and re.search(r"\d", m[1]) and not _UUID.match(m[1]) and (stripped.startswith("#") or " #" in line[: m.start() + 1] or stripped.startswith("//")):
            yield Finding(*m.span(1), "comment")


def _login(value: str) -> bool:
    """Whether a text is a user and a password in base64."""
    try:
        user, colon, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).partition(b":")
    except (binascii.Error, ValueError):
        return False
    return bool(user and colon and word) and user.isascii()


def _other(key: str) -> bool:
    """Whether a key tells that its value is no credential, whatever stands above it."""
    words = [w.lower() for w in _WORDS.findall(key)]
    return bool(words) and (words[-1] in OTHER_WORDS or words[0] in ("runs", "timeout", "max", "min", "num"))


def _several(key: str) -> str | None:
    """sensitive() of a key in the plural."""
    return sensitive(key[:-1]) if key[-1:] in "sS" and len(key) > 4 and not sensitive(key) else sensitive(key)


def _above(path: tuple[str, ...]) -> str | None:
    """The kind of the nearest key above the last that holds credentials, unless a key below it tells otherwise."""
    for i in range(len(path) - 1, 0, -1):
        if _other(path[i]):
            return None
        key = path[i - 1]
        if kind := _several(key):
            named = i > 1 and path[i - 2].lower() in NAMING_KEYS or key.lower() in NAMING_KEYS
            return kind if not named or path[-1].lower() in VALUE_KEYS and key.lower() not in NAMING_KEYS else None
    return None


def _inherits(value: str) -> bool:
    """Whether a value below a key that holds credentials is one by its shape, as its own key does not tell."""
    if not literal(value) or re.search(r"\s", value) or _UUID.match(value) or not _COMPACT.fullmatch(value):
        return False
    digits, lower, upper = (any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper))
    return digits and lower and upper and len(value) >= 8 or digits and (lower or upper) and len(value) >= 16 and not _HEX.fullmatch(value)


def _in_scalar(text: str, s: Scalar) -> Iterator[Finding]:
    """The credentials that the key of a YAML value tells: the value over all its lines, or the lines of a block that stand for themselves."""
    kind = _several(s.path[-1]) if s.path else None
    if not kind and s.name:
        kind = sensitive(s.name)
    value = text[s.start : s.end]
    if not kind:
        if any(n and _STORE.search(n) for n in (s.path[-1] if s.path else None, s.name)) and _STORED.fullmatch(re.sub(r"\s+|\\(?=\s)", "", value)) and _random(re.sub(r"\s", "", value), 64):
            yield Finding(s.start, s.end, "key name")
        elif not s.name and _above(s.path) and _inherits(value):
            yield Finding(s.start, s.end, "key path")
        return
    if s.item and _CONSTANT.fullmatch(value):
        return
    if "\n" not in value and "\r" not in value:
        if holds(value, kind):
            yield Finding(s.start, s.end, "key name")
        return
    lines = list(_LINE_PART.finditer(value))
    words = [m[0].removesuffix("\\").rstrip() if s.style == '"' else m[0] for m in lines]
    single = not any(re.search(r"\s", w) for w in words)
    if s.style not in ("|", ">"):
        one = holds(("" if single else " ").join(words), kind)
    elif single:  # text that was wrapped, else a list
        one = all(map(_WRAPPED.fullmatch, words[:-1])) and _WRAPPED_END.fullmatch(words[-1]) is not None and holds("".join(words), kind)
    else:  # a phrase; a script or a list of settings is none
        one = kind == "pass" and not re.search(r"[=:;(){}$|]", value) and holds(" ".join(words), kind)
    if one:
        yield Finding(s.start, s.end, "key name")
    elif s.style in ("|", ">"):
        for m in lines:
            if not re.search(r"\s", m[0]) and holds(m[0], kind):
                yield Finding(s.start + m.start(), s.start + m.end(), "key name")


def _squeezed(low: str) -> str:
    """Without the signs that sensitive() passes over inside a name."""
    return low.replace("_", "").replace("-", "")


@lru_cache(50_000)
def _tells(name: str) -> bool:
    """Whether a key or name may make a value a credential: by itself, or by one of its parts above others."""
    name = name.strip()
    return any(_several(part) or _STORE.search(part) for part in {name, *name.split("."), *name.split(" ")} if part)


def _read(text: str | None) -> tuple[list[Finding], list[Scalar]]:
    """The credentials of a text in order, none inside another; its YAML values, where there may be any."""
    if not text:
        return [], []
    lowered = text.lower()
    squeezed = _squeezed(lowered)
    hints, forms = [w for w in _HINTS if w in squeezed], [w for w in _FORM_HINTS if w in text]
    if not hints and not forms:
        return [], []
    found: list[Finding] = []
    for m in _PEM.finditer(text):
        end = _PEM_END.search(text, m.end())
        stop = end.end() if end else len(text)
        nearest = text.find("-----BEGIN", m.end(), stop)
        body = text[m.end() : min(end.start() if end else len(text), nearest if nearest >= 0 else len(text))]
        if _BODY.search(body):
            last = max(x.end() for x in _BODY.finditer(body))
            found.append(Finding(m.start(), stop if end and nearest < 0 else m.end() + last, "private key"))
    armoured, start, told = list(found), 0, False
    hinted = re.compile("|".join(hints)).search if hints else None
    # lower case and squeezing leave line feeds as they are
    for line, low, bare in zip(text.split("\n"), lowered.split("\n"), squeezed.split("\n")):
        if forms and any(w in line for w in forms):
            found.extend(Finding(start + m.start(), start + m.end(), "token form") for m in _FORM.finditer(line) if literal(m[0]) and len(set(m[0])) > 7)
        if hinted and hinted(bare):
            found.extend(Finding(start + f.start, start + f.end, f.kind) for f in _in_line(line.rstrip("\r"), low))
            told = told or any(_tells(m[1] or m[2]) for m in _KEYS.finditer(line)) or any(_tells(m[1]) for m in _BESIDE.finditer(line))
        start += len(line) + 1
    for m in _BLOCK.finditer(text) if told else ():
        if kind := sensitive(m[2]):
            depth = len(m[1].expandtabs(1))
            rest = _VALUE_LINE.match(text, m.end())
            value = rest[2].rstrip("\r \t")
            if rest and len(rest[1]) > depth and holds(value, kind) and not value.startswith(("-", "#")) and ": " not in value and not value.endswith(":"):
                found.append(Finding(rest.start(2), rest.start(2) + len(value), "key name"))
    for m in _NAMED.finditer(text) if told else ():
        if kind := sensitive(m[2]):
            stop = text.find("\n", m.end())
            line = text[m.end() : stop if stop >= 0 else len(text)].rstrip("\r")
            a, b = _value(line, 0, "\n")
            value = line[a:b] if a else re.split(r"[ \t]+#", line, maxsplit=1)[0].rstrip()
            if holds(value, kind):
                found.append(Finding(m.end() + a, m.end() + a + len(value), "key name"))
    # without a key or name that tells, no value is a credential, and without findings no place is asked for
    values = settings(text) if found or told else []
    quotes = {s.start - 1 for s in values if s.style in ("'", '"')}  # a quoted value may go on after its first line
    found = [f._replace(start=f.start + 1) if f.start in quotes and f.kind == "key name" else f for f in found]
    for s in values:
        # of a private key only the lines of the key are masked
        found.extend(f for f in _in_scalar(text, s) if not any(f.start < k.end and k.start < f.end for k in armoured))
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not out or f.start >= out[-1].end:
            out.append(f)
        elif f.end > out[-1].end and "private key" not in (f.kind, out[-1].kind):
            out[-1] = out[-1]._replace(end=f.end)
    return out, values


def findings(text: str | None) -> list[Finding]:
    """The credentials of a text in order, none inside another."""
    return _read(text)[0]


def redacted(text: str | None) -> str | None:
    """The text with every finding masked; one of several lines line by line, so that line breaks and a private key's header and end stay."""
    if not text:
        return text
    parts, at = [], 0
    for f in findings(text):
        secret = text[f.start : f.end]
        parts.append(text[at : f.start])
        if f.kind == "private key":
            head = _PEM.match(secret).end()
            end = m.start() if (m := _PEM_END.search(secret)) else len(secret)
            parts.append(secret[:head] + _BODY_PART.sub(lambda x: x[0] if x[0][0] == "\\" else MASK, secret[head:end]) + secret[end:])
        else:
            parts.append(_LINE_PART.sub(MASK, secret) if re.search(r"[\r\n]", secret) else MASK)
        at = f.end
    return "".join([*parts, text[at:]])


_YAML_KEY = re.compile(r"^([ ]*(?:- +)*)[\"']?([\w.\-]+)[\"']?[ \t]*:(?:\s|$)")


def key_path(text: str, place: int, values: list[Scalar], around: list[int]) -> str:
    """The keys of the value that holds `place`, joined by dots; outside of values the YAML keys above and on its line."""
    if (own := holder(values, around, place)) is not None:
        return ".".join(own.path)
    keys, depth = [], 1 << 30
    stop = text.find("\n", place)
    for line in reversed(text[: stop if stop >= 0 else len(text)].split("\n")):
        if depth == 0:
            break
        m = _YAML_KEY.match(line)
        if m and len(m[1]) < depth:
            keys.append(m[2])
            depth = len(m[1]) - (len(m[1].lstrip(" ")) and 0)
    return ".".join(reversed(keys))


_FOUND = "array<struct<line_no: int, kind: string, key_path: string, first_byte: int, end_byte: int>>"


def credentials(text: Column) -> Column:
    """array<struct<line_no, kind, key_path, first_byte, end_byte>>, places in the UTF-8 text; empty for null and empty texts."""

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series) -> pd.Series:
        def rows(t: str | None) -> list[dict]:
            out = []
            found, values = _read(t)
            around = enclosing(values)
            for f in found:
                first = len(t[: f.start].encode())
                out.append({"line_no": t.count("\n", 0, f.start) + 1, "kind": f.kind, "key_path": key_path(t, f.start, values, around), "first_byte": first, "end_byte": first + len(t[f.start : f.end].encode())})
            return out

        return texts.map(rows)

    # not to be evaluated again where a filter on the result is pushed down
    return found.asNondeterministic()(text)


def mask(text: Column) -> Column:
    """The text with its credentials masked; null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    return masked.asNondeterministic()(text)


def p7_places(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, line_no, kind, key_path, first_byte, end_byte of every credential."""
    files = spread(table(spark, folder, "yaml_reference").select("workflow_id", "collected_at", "full_workflow_yaml"))
    rows = files.select("workflow_id", "collected_at", F.explode(credentials(F.col("full_workflow_yaml"))).alias("f"))
    return rows.select("workflow_id", "collected_at", "f.*")


def p7_masked(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, full_workflow_yaml with the credentials masked, for every row."""
    files = spread(table(spark, folder, "yaml_reference").select("workflow_id", "collected_at", "full_workflow_yaml"))
    return files.select("workflow_id", "collected_at", mask(F.col("full_workflow_yaml")).alias("full_workflow_yaml"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, line_no of the lines on which a credential starts."""
    return p7_places(spark, folder).select("workflow_id", "line_no").distinct()
