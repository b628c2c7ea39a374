"""Which changed files say something, and how much of a patch is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPARSE_COMMITS, MOST_FILES, PATCH_LINES, PATCH_WIDTH = 5, 5, 5, 300
GENERATED = ("dist", "build", "node_modules", "vendor", ".venv", "target")
BOILERPLATE = tuple(
    "license license.md license.txt notice package-lock.json yarn.lock bun.lock bun.lockb pnpm-lock.yaml cargo.lock go.sum poetry.lock uv.lock gemfile.lock "
    "composer.lock".split()
)
# End of the fixed values.


def is_low_signal(name: Column) -> Column:
    """Whether a path is a lock or licence file, minified, or lies in a folder of generated files."""
    low = F.lower(F.coalesce(name, F.lit("")))
    parts = F.split(low, "/")
    base = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return base.isin(*BOILERPLATE) | F.exists(folders, lambda p: p.isin(*GENERATED)) | base.rlike(r"(\.min\.js|\.min\.css|\.lock)\z")


def shown_patch(name: Column, patch: Column) -> Column:
    """The first lines of a patch, each cut, with an ellipsis for more; empty for files of low signal."""
    cut = F.transform(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: F.substring(x, 1, PATCH_WIDTH))
    short = F.when(F.size(cut) > PATCH_LINES, F.concat(F.slice(cut, 1, PATCH_LINES), F.array(F.lit("…")))).otherwise(cut)
    return F.when(is_low_signal(name), "").otherwise(F.array_join(short, "\n"))


def shown_files(files: Column) -> Column:
    """The files of a commit as they are shown: the first few, patches cut, missing counts 0."""
    zero = F.lit(0).cast("bigint")
    one = lambda f: F.struct(
        f["filename"].alias("filename"), F.coalesce(f["additions"], zero).alias("additions"), F.coalesce(f["deletions"], zero).alias("deletions"),
        shown_patch(f["filename"], f["patch"]).alias("patch"),
    )
    return F.transform(F.slice(F.coalesce(files, F.array().cast(FILES)), 1, MOST_FILES), one)


FILE = "struct<filename:string,additions:bigint,deletions:bigint,patch:string>"
FILES = f"array<{FILE}>"
COMMIT = f"struct<sha:string,message:string,url:string,files:{FILES}>"
REPO = f"struct<repo:string,commits:array<{COMMIT}>>"
ACTIVITY = f"array<{REPO}>"
