"""Rules on rows: paths, permissions, identifiers, keywords, workflow conditions, the plugin catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import extension

# What the scanner leaves out.
IGNORED = ["$Recycle.Bin", "System Volume Information", "\\$"]
# The preview's kinds of files by extension; every other file is binary.
FILE_TYPES = {
    "image": ["png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "ico"],
    "markdown": ["md", "markdown"],
    "json": ["json"],
    "code": [
        "rs", "js", "jsx", "ts", "tsx", "py", "go", "java", "cpp", "c", "cs", "php", "rb", "sh", "bash", "zsh",
        "yml", "yaml", "toml", "xml", "html", "css", "scss", "sass", "less", "sql", "r", "swift", "kt", "scala",
    ],
    "text": ["txt", "log", "csv", "ini", "cfg", "conf", "properties", "env", "gitignore", "dockerfile"],
}
# The sign shown for a file by its extension, for any other file, and for a folder.
ICONS = {
    "txt": "📄", "md": "📄", "log": "📄", "pdf": "📕", "doc": "📘", "docx": "📘", "xls": "📊", "xlsx": "📊", "ppt": "📊", "pptx": "📊", "zip": "📦", "rar": "📦", "7z": "📦",
    "jpg": "🖼️", "jpeg": "🖼️", "png": "🖼️", "gif": "🖼️", "bmp": "🖼️", "mp3": "🎵", "wav": "🎵", "flac": "🎵", "mp4": "🎬", "avi": "🎬", "mkv": "🎬",
    "exe": "⚙️", "msi": "⚙️", "js": "💻", "ts": "💻", "py": "💻", "rs": "💻", "go": "💻", "java": "💻",
}
FILE_ICON, FOLDER_ICON = "📄", "📁"
# The beginnings of permissions.
PERMISSIONS = ["network:", "filesystem:read:", "filesystem:write:", "clipboard:read", "clipboard:write", "system:info", "system:execute", "database:read", "database:write"]
# The first words that send a query to one source.
TRIGGERS = {
    "bm": "bookmarks", "his": "history", "ps": "process", "kill": "process", "git": "git", "project": "git", "trans": "translator", "tr": "translator", "翻译": "translator",
    "json": "devtools", "base64": "devtools", "md5": "devtools", "hash": "devtools", "sha256": "devtools", "url": "devtools", "?": "web",
}
# The keywords of the settings page.
KEYWORDS = ["settings", "setting", "config", "preferences", "设置", "配置"]


def ignored(path: Column, marks: list[str] | None = None) -> Column:
    out = F.lit(False)
    for mark in marks or IGNORED:
        out = out | F.contains(path, F.lit(mark))
    return out


def path_priority(path: Column) -> Column:
    """By ending, else by the folder's mark; case counts."""
    ends = lambda *e: F.rlike(path, F.lit(r"\.(" + "|".join(e) + ")$"))
    inside = F.contains(path, F.lit("Program Files")) | F.contains(path, F.lit("Windows"))
    return F.when(ends("exe"), 100).when(ends("lnk"), 90).when(ends("bat", "cmd"), 80).when(inside, 70).otherwise(50).cast("long")


def file_type(path: Column) -> Column:
    """The preview's kind of a file."""
    out = F.when(F.lit(False), "")
    for name, ends in FILE_TYPES.items():
        out = out.when(extension(path).isin(ends), name)
    return out.otherwise("binary")


def icon(path: Column, is_folder: Column | None = None) -> Column:
    """The sign of a file or folder."""
    signs = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    sign = F.coalesce(F.try_element_at(signs, extension(path)), F.lit(FILE_ICON))
    return sign if is_folder is None else F.when(is_folder, FOLDER_ICON).otherwise(sign)


def valid_id(id_: Column) -> Column:
    """At least three parts between dots, none empty."""
    parts = F.split(id_, r"\.")
    return (F.size(parts) >= 3) & F.forall(parts, lambda p: p != "")


def valid_permission(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, PERMISSIONS)), lambda p: F.startswith(text, p))


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (request_id, plugin_id, kind, arg) with allowed.

    grants: plugin_id, kind, arg.  A path is allowed below a granted one, whether to read or write; a domain where it
    equals a granted one or all are; what else, where its kind and argument are granted.
    """
    kind, arg = F.col("kind"), F.col("arg")

    def fits(g: Column) -> Column:
        path = kind.isin("read", "write") & g["kind"].isin("read", "write") & ((arg == g["arg"]) | F.startswith(arg, F.concat(F.rtrim(g["arg"], F.lit("/")), F.lit("/"))))
        network = (kind == "network") & (g["kind"] == "network") & ((g["arg"] == "*") | (g["arg"] == arg))
        other = ~kind.isin("read", "write", "network") & (kind == g["kind"]) & arg.eqNullSafe(g["arg"])
        return F.coalesce(path | network | other, F.lit(False))

    held = grants.groupBy("plugin_id").agg(F.collect_set(F.struct("kind", "arg")).alias("_grants"))  # the grants of one plugin
    rows = requests.join(held, "plugin_id", "left")
    return rows.select(*[F.col(c) for c in requests.columns], F.coalesce(F.exists("_grants", fits), F.lit(False)).alias("allowed"))


def keyword_any(keywords: Column, query: Column) -> Column:
    """Whether a keyword contains the query, or the query a keyword."""
    q = F.lower(query)
    return F.exists(keywords, lambda k: F.contains(F.lower(k), q) | F.contains(q, F.lower(k)))


def keyword_score(query: Column) -> Column:
    """100 where a keyword of the settings page begins with the query, 80 for other matches, else null."""
    words, q = F.array(*map(F.lit, KEYWORDS)), F.lower(query)
    return F.when(q == "", None).when(F.exists(words, lambda k: F.startswith(k, q)), 100).when(keyword_any(words, q), 80).cast("long")


def routed(queries: DataFrame, text: str = "query") -> DataFrame:
    """queries with source and rest: the source of their first word, and what follows it."""
    parts = F.split(text, " ", 2)
    source = F.when(F.size(parts) == 2, F.element_at(F.create_map(*[F.lit(x) for pair in TRIGGERS.items() for x in pair]), parts[0]))
    return queries.withColumn("source", F.coalesce(source, F.lit("all"))).withColumn("rest", F.when(source.isNotNull(), F.trim(parts[1])).otherwise(F.col(text)))


def condition(spec: dict, variables: Column) -> Column:
    """A workflow's condition on a map of variables, as a column.

    {"type": "VariableEquals", "name", "value"}, {"type": "VariableContains", "name", "substring"}, {"type": "And" or
    "Or", "conditions"}, {"type": "Not", "condition"}, {"type": "TimeRange", "start", "end"} on the variable now ("HH:MM",
    with a range past midnight where end is before start).  What cannot be told holds: other types, and a TimeRange where
    the variables have no now.
    """
    kind = spec.get("type")
    if kind == "VariableEquals":
        return F.coalesce(variables[spec["name"]] == spec["value"], F.lit(False))
    if kind == "VariableContains":
        return F.coalesce(F.contains(variables[spec["name"]], F.lit(spec["substring"])), F.lit(False))
    if kind in ("And", "Or"):
        out = F.lit(kind == "And")
        for c in spec["conditions"]:
            out = out & condition(c, variables) if kind == "And" else out | condition(c, variables)
        return out
    if kind == "TimeRange":
        at, start, end = variables["now"], spec["start"], spec["end"]
        inside = (at >= start) & (at <= end) if start <= end else (at >= start) | (at <= end)
        return F.coalesce(inside, F.lit(False)) | ~F.map_contains_key(variables, "now")
    if kind == "Not":
        return ~condition(spec["condition"], variables)
    return F.lit(True)


def substituted(template: Column, variables: Column, names: list[str]) -> Column:
    """A template with ${name} replaced by the variable; a null variable leaves it."""
    out = template
    for name in names:
        out = F.when(variables[name].isNotNull(), F.replace(out, F.lit("${" + name + "}"), variables[name])).otherwise(out)
    return out


def catalogue_page(plugins: DataFrame, text: str, sort: str, page: int, size: int) -> DataFrame:
    """A page of plugins whose name or description contains text, by downloads, rating or date."""
    key = {"downloads": "downloads", "rating": "rating", "date": "published"}[sort]
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("description"), F.lit(text.lower()))
    return plugins.where(hit).orderBy(F.desc(key), "id").offset(page * size).limit(size)


def updates(installed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, version, latest) of installed plugins whose version is not the catalogue's."""
    rows = installed.select("id", "version").join(catalogue.select("id", F.col("version").alias("latest")), "id")
    return rows.where("version <> latest")


def missing(needs: DataFrame, installed: DataFrame) -> DataFrame:
    """needs (id, needed) that are not installed."""
    return needs.join(installed.select(F.col("id").alias("needed")), "needed", "left_anti").select("id", "needed")
