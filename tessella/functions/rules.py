"""Rule tables of the semantics, and the column expressions that read them.

The lists and patterns under "fixed values" decide results and are stated as they are. All expressions are native columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------

#: Redaction before storing, in order of application.
SECRETS = (
    r"(?i)(?:sk|pk|api[_-]?key)[_-]?[a-zA-Z0-9]{20,}",
    r"(?i)(?:password|passwd|pwd|secret|token)\s*[:=]\s*\S+",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}",
    r"(?i)(?:bearer|authorization)\s+\S+",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
)

#: Openers of questions and connectors that speak for a relational query.
WH_WORDS = ("who", "whom", "whose", "which", "where", "when", "why", r"how\s+often", r"how\s+many", "кто", "кому", "чей", "чья", "чьё", "который", "которая", "где", "куда", "откуда", "когда", "почему", "сколько", r"каким\s+образом")
CONNECTORS = (
    "between", r"together\s+with", r"along\s+with", "alongside", r"related\s+to", r"connected\s+to", r"linked\s+to", r"associated\s+with",
    r"works?\s+(?:with|on)", "owns", r"owned\s+by", r"created\s+by", r"maintained\s+by", r"depends?\s+on", "uses?", r"integrate[sd]?\s+with", r"replaced\s+by", "contradict[s]?", "supersede[sd]?",
    "между", r"связан[аыо]?\s+с", r"связь\s+между", r"вместе\s+с", r"работа(?:ет|ют|л[аи]?)\s+(?:над|с)", "использу(?:ет|ют|л[аи]?)", r"зависит\s+от",
)
ENTITY_FORMS = ("[A-ZА-Я][a-zа-я0-9_-]{2,}", "[a-z][a-z0-9_]{2,}_[a-z0-9_]+", "[a-z][a-z0-9-]{2,}-[a-z0-9-]+")
NOT_ENTITIES = ("what", "which", "where", "when", "who", "how", "why", "the", "and", "but", "for", "with", "from", "into", "onto", "что", "кто", "где", "когда", "почему", "как", "какой", "это", "тот", "такой")

#: Kinds of queries by the first list with a word in them.
INTENTS = {
    "debug": ("error", "ошибка", "bug", "fix", "broken", "fail", "не работает", "crash"),
    "factual": ("что", "what", "where", "где", "какой", "какая", "какое", "стек", "порт", "url", "пароль", "домен", "версия", "кто", "сколько"),
    "architecture": ("architect", "архитектур", "структур", "pattern", "design", "подход", "выбор", "сравн"),
    "solution": ("как", "how", "implement", "реализ", "сделать", "настро", "создать"),
}
TEMPORAL_WORDS = (
    "when", "first", "last", "before", "after", "since", "until", "during", "ago", "recently", "earlier", "later", "yesterday", "tomorrow", "today", "week", "weekend", "month", "year",
    "когда", "первый", "последний", "до", "после", "с", "недел", "месяц", "год", "раньше", "позже",
)

#: Content types by file ending, and signatures of contents.
EXTENSIONS = {
    "markdown": ("md", "markdown", "rst"),
    "text": ("txt",),
    "code": ("py", "pyi", "go", "rs", "js", "mjs", "cjs", "ts", "tsx", "jsx", "vue", "php", "rb", "java", "kt", "swift", "cs", "cpp", "cc", "cxx", "hpp", "h", "c"),
    "sql": ("sql",),
    "json": ("json", "jsonl"),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "ini": ("ini", "cfg"),
    "env": ("env",),
    "shell": ("sh", "bash", "zsh"),
    "config": ("dockerfile",),
    "log": ("log",),
}
STACK_TRACES = (
    r"Traceback \(most recent call last\):",
    r"(?m)^\s*at\s+[\w$.]+\([\w./:]+\)$",
    r"(?m)^\s*at\s+\S+\s+\(.*:\d+:\d+\)$",
    r"(?m)^goroutine \d+ \[",
)
LOG_LEVEL = r"(?i)\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b\s*[:|\]]"
LOG_TIME = r"(?m)^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
YAML_START, YAML_KEY = r"(?m)^---\s*$", r"(?m)^[A-Za-z_][\w-]*:\s"
TOML_TABLE, INI_SECTION, ENV_LINE = r"(?m)^\[\w[\w.-]*\]\s*$", r"(?m)^\[[^\]]+\]\s*$", r"^[A-Z_][A-Z0-9_]*\s*="
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE\s+(?:TABLE|INDEX|VIEW)|DROP\s+(?:TABLE|INDEX)|ALTER\s+TABLE|JOIN|WHERE|GROUP\s+BY|ORDER\s+BY)\b"
SHELL_HEAD, SHELL_WORDS = r"\A#!.*?(?:bash|sh|zsh)\b", r"(?m)^\s*(?:if\s|for\s|while\s|case\s|export\s|function\s|\$\(|`|\.\/|sudo\s)"
CODE_STRONG = (
    r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\([^)]*\)\s*(?:->\s*[\w\[\], .]+)?\s*:",
    r"(?m)^\s*func\s+(?:\([^)]+\)\s*)?\w+\s*\([^)]*\)[^{\n]*\{",
    r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+\w+\s*[<(]",
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+\w+\s*\(",
    r"\b(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    r"(?m)^\s*class\s+\w+\s*[:({]",
    r"<\?php\b",
    r"(?m)^\s*(?:public|private|protected|static)\s+[\w<>\[\]]+\s+\w+\s*\([^)]*\)\s*\{",
)
CODE_HINTS = (
    r"(?m)^\s*(?:import|from)\s+[\w.]+",
    r"(?m)^\s*func\s+\w+",
    r"(?m)^\s*fn\s+\w+",
    r"(?m)^\s*(?:public|private|protected)\s+\w+\s+\w+\s*\(",
    r"(?m)^\s*(?:class|interface|trait)\s+\w+",
    r"(?m)^\s*(?:def|async\s+def)\s+\w+\s*\(",
    r"(?m)^\s*(?:const|let|var)\s+\w+\s*=",
    r"(?m)^\s*<\?php\b",
)
FENCE, HEADING, BULLET = "```", r"(?m)^#{1,6}\s+\S", r"(?m)^[-*]\s+\S"

#: Spaces of embeddings by content type.
SPACES = {
    "text": ("text", "markdown", "mixed", "unknown", "prose"),
    "code": ("code", "source", "patch", "diff", "git_patch"),
    "config": ("sql", "json", "yaml", "toml", "ini", "env", "shell", "bash", "config"),
    "log": ("log", "logs", "stacktrace", "traceback", "error"),
}

#: Levels of tasks: words from the highest level down, further patterns of level 2, phases and tokens.
TASK_WORDS = {
    4: ("architecture", "redesign", "multi-service", "multi service", "re-architect", "rearchitect", "microservice", "system overhaul", "platform redesign"),
    3: ("refactor", "migrate", "migration", "implement feature", "new module", "rework", "restructure", "overhaul"),
    2: ("add endpoint", "new page", "update docs", "add field", "add route", "new component", "extend api", "add method"),
    1: ("fix typo", "typo", "bump", "rename", "quick fix", "fix", "patch version", "update version"),
}
TASK_FORMS = (r"\badd\b.{0,30}\bendpoint\b", r"\badd\b.{0,30}\broute\b", r"\bnew\b.{0,20}\b(?:page|component|endpoint|route)\b", r"\bextend\b.{0,20}\bapi\b")
TASK_PHASES = {1: ("van", "build", "reflect", "archive"), 2: ("van", "plan", "build", "reflect", "archive"), 3: ("van", "plan", "creative", "build", "reflect", "archive"), 4: ("van", "plan", "creative", "build", "reflect", "archive")}
TASK_TOKENS = {1: 2_000, 2: 8_000, 3: 25_000, 4: 80_000}

#: What messages of a user show.
CORRECTIONS = (r"нет,?\s+(не\s+)?т(ак|о)", r"не\s+правильно", r"не\s+то", r"я\s+говор(ю|ил)", r"не\s+нужно", "убери", "верни", "wrong", "not what I", "undo", "revert", "не надо", "отмени", "откати", r"не так\b", "заново", "переделай")
APPROVALS = ("спасибо", "отлично", "супер", r"да,?\s+именно", "правильно", "хорошо", "perfect", "great", "thanks", "круто", "класс", "молодец", "замечательно", "exactly", "awesome", "nice", "👍", "то что нужно", "в точку")
RETRIES = (r"попробуй\s+(ещё|еще|снова|опять)", r"try\s+again", "ещё раз", "еще раз", "заново", "retry", r"давай\s+снова", r"не\s+работает", r"doesn'?t\s+work", r"still\s+(broken|failing|wrong)", r"опять\s+(не|ошибка)")

#: Categories of contents in ingestion, and weights of warnings.
CODE_FORMS = (r"```\w*\n", r"(?m)^\s*(?:def |class |func |function |const |let |var |import |from |package )", r"(?m)^\s*(?:if\s*\(|for\s*\(|while\s*\(|switch\s*\(|try\s*\{)", r"=>|->|\{\}|\[\]|::\s*\w+")
CONFIG_FORMS = (r"(?m)^\s*\[[\w.-]+\]\s*$", r"(?m)^\w+\s*[:=]\s*", r"(?m)^\s*-\s+\w+:", r"(?m)^\s*\"[\w.-]+\":\s*")
DOC_FORMS = (r"(?m)^#{1,6}\s+", r"(?m)^\*\*[^*]+\*\*", r"(?m)^>\s+", r"(?m)^\d+\.\s+")
DISCUSSION_WORDS = ("think", "should", "could", "maybe", "consider", "suggest", "agree", "disagree")
SEVERITY = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.1}

#: Words that say nothing about a text's subject.
KEYWORD_STOPS = ("the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "and", "or", "not", "this", "that", "it", "be", "as", "by", "from", "but", "has", "had", "have", "i", "we", "you", "use", "using", "used", "can", "will")

#: Fingerprints of command output: name, patterns, how many must show. The first that fits decides.
SIGNATURES = (
    ("stack_trace", (r"(?m)^Traceback \(most recent call last\)", r"(?m)^\s+File \"[^\"]+\", line \d+", r"(?m)^\w+(?:Error|Exception): ", r"(?m)^panic: ", r"(?m)^goroutine \d+ \[", r"(?m)^\s+at \S+\.\w+\("), 2),
    ("pytest", (r"(?i)test session starts", r"(?m)^(?:FAILED|PASSED|ERROR)\b", r"::\w+ (?:PASSED|FAILED|ERROR)", r"\d+ failed,.*\d+ passed", r"AssertionError", r"(?m)^=+ "), 2),
    ("cargo", (r"(?m)^\s+Compiling \S+ v\d", r"(?m)^\s+Finished (?:dev|release)", r"(?m)^error\[E\d+\]:", r"(?m)^warning: ", r"-->\s+\S+\.rs:\d+:\d+"), 2),
    ("git_status", (r"(?m)^On branch ", r"Your branch is (?:up to date|ahead|behind)", r"(?m)^(?:Changes (?:not staged|to be committed)|Untracked files):", r"(?m)^\s+(?:modified|new file|deleted):\s+"), 2),
    ("docker_ps", (r"(?m)^CONTAINER ID\s+IMAGE", r"\bUp \d+ (?:seconds|minutes|hours|days)", r"\bExited \(\d+\)"), 2),
    ("npm_yarn", (r"(?m)^npm (?:ERR|WARN|notice)", r"(?m)^yarn (?:install|add|run) ", r"(?m)^\[\d+/\d+\] ", r"added \d+ packages? in", r"\d+ vulnerabilit"), 2),
    ("http_log", (r"\"\w+ \S+ HTTP/[\d.]+\" \d{3}", r"(?m)^\S+ - - \[\d+/\w+/\d{4}", r"\b(?:GET|POST|PUT|DELETE|PATCH) /\S+ HTTP/"), 2),
    ("sql_explain", (r"Seq Scan|Index Scan|Index Only Scan|Bitmap Heap Scan|Hash Join|Nested Loop|Merge Join", r"actual time=[\d.]+\.\.[\d.]+", r"cost=[\d.]+\.\.[\d.]+", r"(?:Planning Time|Execution Time): [\d.]+ ms"), 2),
    ("json_blob", (r"(?m)^\s*[{\[]", r"(?m)^\s*\"[\w_-]+\":\s*", r"(?m)^\s*[}\]],?\s*$"), 3),
    ("markdown_doc", (r"(?m)^#{1,3}\s+\S", r"(?m)^[-*]\s+\S", r"```\w*\n", r"(?m)^\d+\.\s+\S"), 3),
    ("generic_logs", (r"(?m)^\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b", r"(?m)^\s*\[(?:DEBUG|INFO|WARN|ERROR|FATAL)\]", r"(?m)^Traceback \(most recent call last\):"), 3),
)
DENSE = ("generic_logs", "http_log", "json_blob", "markdown_doc")

#: Stages per kind of output.
FILTERS = {
    "pytest": {"strip_ansi": True, "strip_lines": ("^Deprecation", "^collecting", "^collected", "^platform ", "^rootdir", "^plugins:", "^cachedir"), "keep_lines": ("FAILED", "ERROR", "passed", "failed", "error", r"^\S+\.py:\d+:", r"^E\s", "^>", "AssertionError", "^=+ "), "max_lines": 200, "on_empty": "(all tests passed)"},
    "cargo": {"strip_ansi": True, "strip_lines": (r"^\s+Compiling ", r"^\s+Downloading ", r"^\s+Finished ", r"^\s+Running ", r"^\s+Fresh ", r"^\s+Blocking "), "keep_lines": ("^error", "^warning", r"^\s+-->", r"^\s+\|", r"^\s+=\s+help:", r"^\s+=\s+note:", r"^\s+\^+"), "max_lines": 300, "on_empty": "(cargo: no errors or warnings)"},
    "git_status": {"strip_ansi": True, "strip_lines": ("^On branch", "^Your branch is", r"^\s+$", "^nothing to commit", '^  \\(use "git '), "max_lines": 100, "on_empty": "(clean working tree)"},
    "docker_ps": {"strip_ansi": True, "keep_lines": ("^CONTAINER ID", "Up ", "Restarting", "Paused"), "max_lines": 50, "on_empty": "(no running containers)"},
    "npm_yarn": {"strip_ansi": True, "strip_lines": ("^npm WARN deprecated", r"^\s*$", r"^\[\d+/\d+\] ", "Resolving packages", "Fetching packages", "Linking dependencies", "Building fresh packages", "^npm notice"), "keep_lines": ("^npm ERR", "^npm WARN(?! deprecated)", "^error ", "^warning ", r"^\d+ vulnerabilit", r"added \d+ packages", "audit "), "max_lines": 200, "on_empty": "(no errors or warnings)"},
    "http_log": {"strip_ansi": True, "strip_lines": (" 200 ", " 201 ", " 204 ", " 304 "), "keep_lines": (r" (4|5)\d\d ", "(error|ERROR|Error)", "(timeout|Timeout|TIMEOUT)", "slow", "rate.?limit"), "truncate_chars": 400, "max_lines": 200, "on_empty": "(no errors or slow requests)"},
    "sql_explain": {"strip_lines": (r"^\s*$", r"^\(\d+ rows?\)"), "keep_lines": ("Seq Scan|Index Scan|Index Only|Bitmap|Hash|Nested Loop|Merge", "actual time=|cost=|rows=|width=", "Planning Time|Execution Time|Total runtime", "Buffers:|I/O Timings"), "max_lines": 100, "on_empty": "(empty plan)"},
    "stack_trace": {"strip_ansi": True, "strip_lines": (r"^\s+at node:internal", r"^\s+at internal/", r"^\s+at process\."), "keep_lines": ("Traceback", r"^\s*File \"", r"^\s+at ", r"^\w+Error", r"^\w+Exception", "^panic:", "^goroutine", "^Caused by", r"^\s+at\s+\S+\.\w+\("), "max_lines": 80, "on_empty": "(no stack trace)"},
    "json_blob": {"strip_lines": (r"^\s*$",), "truncate_chars": 400, "max_lines": 200, "on_empty": "(empty json)"},
    "markdown_doc": {"strip_lines": (r"^\s*<!--", r"^\s*$"), "truncate_chars": 600, "max_lines": 400, "on_empty": "(empty doc)"},
    "generic_logs": {"strip_ansi": True, "strip_lines": ("^DEBUG", r"^\s*\[DEBUG\]", "^TRACE", "^INFO", r"^\s*\[INFO\]"), "keep_lines": ("WARN", "ERROR", "FATAL", "Exception", "Traceback", "panic:"), "truncate_chars": 500, "max_lines": 300, "on_empty": "(no warnings or errors)"},
}
#: Substrings that filtering must not lose.
PRESERVED = ((r"https?://[^\s<>`'\"()]+", 0), (r"(?:^|\s)(/[A-Za-z0-9_.\-][A-Za-z0-9_./\-]*)", 1), (r"(?:^|\s)(~/[A-Za-z0-9_./\-]+)", 1), (r"`[^`\n]+`", 0))
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"

# --- expressions -------------------------------------------------------------------------------------


def any_of(text: Column, patterns, flags: str = "") -> Column:
    """Whether one of the patterns occurs."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def any_word(text: Column, words) -> Column:
    """Whether one of the words occurs anywhere, as a plain substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def hits(text: Column, patterns) -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out


def matches(text: Column, patterns) -> Column:
    """How often the patterns occur, all together."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(p))
    return out


def redact_secrets(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def entity_candidates(q: Column) -> Column:
    """Names and identifiers of a query, each once, without question words."""
    found = F.regexp_extract_all(q, F.lit(rf"(?U)\b(?:{'|'.join(ENTITY_FORMS)})\b"), F.lit(0))
    return F.filter(F.array_distinct(F.transform(found, F.lower)), lambda w: ~w.isin(*NOT_ENTITIES))


def route(q: Column) -> Column:
    """(kind, confidence, entities): relational, hybrid or semantic, by question words, connectors and names."""
    entities = entity_candidates(q)
    n = F.size(entities)
    wh = F.when(q.rlike(rf"(?iU)\b(?:{'|'.join(WH_WORDS)})\b"), 0.35).otherwise(0.0)
    link = F.when(q.rlike(rf"(?iU)\b(?:{'|'.join(CONNECTORS)})\b"), 0.45).otherwise(0.0)
    score = F.least(F.lit(1.0), wh + link + F.when(n >= 2, 0.35).when(n == 1, 0.10).otherwise(0.0))
    # Sums such as 0.35 + 0.45 stand a last digit beside their decimal value.
    kind = F.when(score >= 0.6 - 1e-9, "relational").when(score >= 0.3 - 1e-9, "hybrid").otherwise("semantic")
    empty = F.coalesce(F.btrim(q), F.lit("")) == ""
    confidence = F.when(kind == "relational", score).otherwise(1.0 - score)
    return F.struct(F.when(empty, "hybrid").otherwise(kind).alias("kind"), F.when(empty, 0.0).otherwise(confidence).alias("confidence"), F.when(empty, F.array().cast("array<string>")).otherwise(entities).alias("entities"))


def query_intent(q: Column) -> Column:
    low, out = F.lower(q), F.lit("search")
    for name, words in reversed(INTENTS.items()):
        out = F.when(any_word(low, words), name).otherwise(out)
    return out


def content_type(text: Column, path: Column | None = None) -> Column:
    """A file's type by its ending, else by the first signature that its first 8192 characters show."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 8192)
    by_content = _content_type(head)
    if path is None:
        return by_content
    name = F.lower(F.substring_index(path, "/", -1))
    ending = F.when(name.rlike(r"[^.]\.[^.]+$"), F.substring_index(name, ".", -1)).otherwise("")
    out = F.when(name.isin("dockerfile", "containerfile", "makefile"), "config").when((name == ".env") | F.startswith(name, F.lit(".env.")), "env")
    for kind, endings in EXTENSIONS.items():
        out = out.when(ending.isin(*endings), kind)
    return F.coalesce(out, by_content)


def _content_type(t: Column) -> Column:
    count = lambda p: F.regexp_count(t, F.lit(p))
    # In brackets, so that nothing may follow the first value.
    whole = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    json = t.rlike(r"^\s*[{\[]") & whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
    lines = F.filter(F.split(t, "\n", -1), lambda s: (F.btrim(s) != "") & ~F.startswith(F.ltrim(s), F.lit("#")))
    set_lines = F.size(F.filter(lines, lambda s: s.rlike(ENV_LINE)))
    env = (F.size(lines) >= 2) & (set_lines >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2)))
    code = any_of(t, CODE_STRONG) | (hits(t, CODE_HINTS) >= 2)
    markdown = (count(FENCE) >= 2) | (count(HEADING) >= 2) | ((count(HEADING) >= 1) & (count(BULLET) >= 2))
    return (
        F.when(F.btrim(t) == "", "text")
        .when(any_of(t, STACK_TRACES), "stacktrace")
        .when((t.rlike(LOG_TIME) & t.rlike(LOG_LEVEL)) | (count(LOG_LEVEL) >= 3), "log")
        .when(json, "json")
        .when(t.rlike(TOML_TABLE), "toml")
        .when(t.rlike(YAML_START) | (count(YAML_KEY) >= 3), "yaml")
        .when(t.rlike(INI_SECTION) & F.contains(t, F.lit("=")), "ini")
        .when(env, "env")
        .when(count(SQL_WORDS) >= 2, "sql")
        .when(t.rlike(SHELL_HEAD) | (count(SHELL_WORDS) >= 2), "shell")
        .when(code, "code")
        .when(markdown, "markdown")
        .otherwise("text")
    )


def embedding_space(kind: Column, language: Column) -> Column:
    """The space of embeddings of a chunk: by type, else code where a language is known, else text."""
    k, out = F.lower(F.btrim(F.coalesce(kind, F.lit("")))), None
    for space, kinds in SPACES.items():
        out = F.when(k.isin(*kinds), space) if out is None else out.when(k.isin(*kinds), space)
    named = ~F.lower(F.btrim(F.coalesce(language, F.lit("")))).isin("", "none", "text", "markdown")
    return out.when(named, "code").otherwise("text")


def lines_of(text: Column) -> Column:
    """Lines without a last empty one."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def filter_output(text: Column, stages: dict, strict: bool = True) -> Column:
    """Text through the stages of a filter; ``strict`` adds addresses, paths and inline code that got lost."""
    out = F.regexp_replace(text, ANSI, "") if stages.get("strip_ansi") else text
    for pattern, by in stages.get("replace", ()):
        out = F.regexp_replace(out, pattern, by)
    lines = lines_of(out)
    touched = any(stages.get(k) is not None for k in ("strip_lines", "keep_lines", "truncate_chars", "head", "tail", "max_lines"))
    if stages.get("strip_lines"):
        lines = F.filter(lines, lambda s: ~any_of(s, stages["strip_lines"]))
    if stages.get("keep_lines"):
        lines = F.filter(lines, lambda s: any_of(s, stages["keep_lines"]))
    if n := stages.get("truncate_chars"):
        lines = F.transform(lines, lambda s: F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s))
    if (n := stages.get("head")) is not None:
        lines = F.slice(lines, 1, max(0, n))
    if (n := stages.get("tail")) is not None:
        lines = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(max(0, n)))
    if (n := stages.get("max_lines")) is not None and n >= 0:
        lines = F.slice(lines, 1, n)
    out = F.array_join(lines, "\n") if touched else out
    if stages.get("on_empty"):
        out = F.when(F.btrim(out, F.lit(" \t\n\r\x0b\x0c")) == "", stages["on_empty"]).otherwise(out)
    return _with_preserved(out, text) if strict else out


def _with_preserved(out: Column, text: Column) -> Column:
    (url, _), *rest = PRESERVED
    urls = F.transform(F.regexp_extract_all(text, F.lit(url), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:!?")))
    found = F.concat(F.array_distinct(urls), *(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(g))) for p, g in rest))
    missing = F.filter(found, lambda p: (p != "") & ~F.contains(out, p))
    tag = F.concat(F.lit("preserved: "), F.array_join(missing, ", "))
    return F.when(F.size(missing) == 0, out).when(out == "", tag).otherwise(F.concat(out, F.lit("\n"), tag))


def detect_filter(text: Column, least: int = 100) -> Column:
    """The first kind of output whose fingerprints a text shows; null for short texts and for documents that quote output."""
    ticks = F.length(text) - F.length(F.replace(text, F.lit("`"), F.lit("")))
    fences = F.regexp_count(text, F.lit(FENCE))
    prose = text.rlike(r"\b[A-Za-z]{4,}\s+[a-z]{3,}\s+[a-z]{3,}")
    is_doc = ((fences > 0) | (ticks - 2 * fences >= 4)) & prose
    lines = F.regexp_count(text, F.lit("\n")) + 1
    out = F.when(F.length(text) < least, F.lit(None).cast("string"))
    for name, patterns, least_hits in SIGNATURES:
        shown = hits(text, patterns)
        enough = (matches(text, patterns) if name in DENSE else shown) >= least_hits
        if name not in ("generic_logs", "json_blob"):
            enough = enough & ((lines >= 5) | (shown >= least_hits + 1))
        if name == "markdown_doc":
            enough = enough & is_doc & (F.length(text) >= 600)
        elif name != "stack_trace":
            enough = enough & ~is_doc
        out = out.when(enough, name)
    return out


def task_level(text: Column) -> Column:
    """Level 1 to 4: by words, the highest level first, else by length."""
    low = F.lower(text)
    n = F.size(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""))
    out = F.when(n < 15, 1).when(n <= 30, 2).when(n <= 60, 3).otherwise(4)
    for level in (1, 2, 3, 4):
        hit = any_word(low, TASK_WORDS[level])
        if level == 2:
            hit = hit | any_of(low, TASK_FORMS)
        out = F.when(hit, level).otherwise(out)
    return out


def task_tokens(level: Column) -> Column:
    """How many tokens a task of a level is expected to take."""
    out = F.lit(None).cast("int")
    for n, tokens in TASK_TOKENS.items():
        out = F.when(level == n, tokens).otherwise(out)
    return out


def has_task_word(text: Column) -> Column:
    low = F.lower(text)
    return any_word(low, [w for words in TASK_WORDS.values() for w in words]) | any_of(low, TASK_FORMS)


def language(text: Column) -> Column:
    """ru where more than .3 of the Cyrillic and Latin letters are Cyrillic, else en."""
    n = lambda p: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), p, ""))
    cyrillic, latin = n("[^Ѐ-ԯ]"), n("[^A-Za-z]")
    return F.when(F.try_divide(cyrillic, cyrillic + latin) > 0.3, "ru").otherwise("en")


def content_category(text: Column) -> Column:
    """code, config, documentation, discussion or other: the best score, in this order on a tie."""
    low, words = F.lower(text), F.lit(0)
    for w in DISCUSSION_WORDS:
        words = words + F.contains(low, F.lit(w)).cast("int")
    talk = words + F.least(F.lit(3), F.regexp_count(text, F.lit(r"\?")))
    code, config, doc = hits(text, CODE_FORMS) * 2, hits(text, CONFIG_FORMS), hits(text, DOC_FORMS)
    best = F.greatest(code, config, doc, talk)
    return F.when(F.coalesce(best, F.lit(0)) == 0, "other").when(code == best, "code").when(config == best, "config").when(doc == best, "documentation").otherwise("discussion")


def message_signals(text: Column) -> Column:
    """(correction, retry, approval) of one message."""
    return F.struct(*(any_of(text, p, "(?iu)").alias(n) for n, p in (("correction", CORRECTIONS), ("retry", RETRIES), ("approval", APPROVALS))))


def satisfaction(corrections: Column, retries: Column, approvals: Column) -> Column:
    rated = corrections + retries + approvals
    return F.when(rated == 0, 0.5).otherwise(F.floor(F.try_divide(approvals, rated) * 1000 + 0.5) / 1000)


def outcome(corrections: Column, retries: Column, approvals: Column) -> Column:
    bad, s = corrections + retries, satisfaction(corrections, retries, approvals)
    return (
        F.when((bad >= 3) & (s < 0.3), "failure")
        .when((bad >= 2) & (approvals >= 2) & (s >= 0.5), "breakthrough")
        .when((approvals >= 3) & (bad == 0) & (s > 0.8), "discovery")
        .otherwise("routine")
    )


def impact(corrections: Column, retries: Column, approvals: Column, messages: Column, minutes: Column | None = None) -> Column:
    struggle = F.when((corrections >= 2) & (approvals >= 2), 0.2).otherwise(0.0)
    busy = F.when(messages > 20, 0.1).when(messages > 10, 0.05).otherwise(0.0)
    long = F.lit(0.0) if minutes is None else F.when(minutes > 60, 0.1).when(minutes > 30, 0.05).otherwise(0.0)
    raw = satisfaction(corrections, retries, approvals) * 0.6 + struggle + busy + long
    quiet = (approvals == 0) & (corrections == 0)
    return F.when(quiet, 0.3).otherwise(F.floor(F.least(F.lit(1.0), raw) * 1000 + 0.5) / 1000)


def warning_weight(severity: Column, is_error: Column, is_open: Column) -> Column:
    out = F.lit(0.25)
    for name, w in SEVERITY.items():
        out = F.when(F.lower(severity) == name, w).otherwise(out)
    return out + F.when(is_error, 0.2).otherwise(0.0) + F.when(is_open, 0.15).otherwise(0.0)


def keywords(text: Column) -> Column:
    """Distinct words of at least three letters or underscores, without those that say nothing."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z_]{3,}"), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(*KEYWORD_STOPS))


#: What a transformed text must keep, and by how much lists may shrink.
BLOCK, LINK = r"(?s)```[^\n]*\n(.*?)```", r"https?://[^\s<>`'\"()]+"
PATH, TITLE, ITEM, SPAN = r"(?:~|/[A-Za-z0-9_.-])(?:/[A-Za-z0-9_.\-]+)+/?", r"(?m)^\s*#{1,6}\s+\S", r"(?m)^\s*(?:[-*+]|\d+\.)\s+\S", r"`([^`\n]+)`"
TOLERANCE = 0.15


def kept_by(before: Column, after: Column) -> Column:
    """What a transformation lost: (blocks, urls, paths, spans, titles_kept, items, ok); ``items`` is ok, warning or error."""
    trim = lambda a: F.array_distinct(F.transform(a, lambda u: F.rtrim(u, F.lit(".,;:!?"))))
    every = lambda t, p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    urls = lambda t: trim(every(t, LINK))
    paths = lambda t: F.filter(trim(every(F.regexp_replace(t, LINK, " "), PATH)), lambda p: F.contains(p, F.lit("/")))
    spans = lambda t: F.filter(F.array_distinct(F.transform(every(F.regexp_replace(t, BLOCK, " "), SPAN, 1), lambda s: F.btrim(s))), lambda s: s != "")
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    lost = {"blocks": F.array_except(every(before, BLOCK, 1), every(after, BLOCK, 1)), "urls": F.array_except(urls(before), urls(after)), "paths": F.array_except(paths(before), paths(after)), "spans": F.array_except(spans(before), spans(after))}
    titles = count(before, TITLE) == count(after, TITLE)
    n, m = count(before, ITEM), count(after, ITEM)
    change = F.try_divide(n - m, n)
    items = F.when(change > max(0.3, TOLERANCE * 2), "error").when(F.abs(change) > TOLERANCE, "warning").otherwise("ok")
    ok = titles & (items != "error")
    for a in lost.values():
        ok = ok & (F.size(a) == 0)
    return F.struct(*(a.alias(k) for k, a in lost.items()), titles.alias("titles_kept"), items.alias("items"), ok.alias("ok"))
