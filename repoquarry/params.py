"""Job parameters and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Suffixes treated as binary, whatever the content.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".ico",
    ".pdf",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".mp3", ".mp4", ".mov", ".avi", ".mkv", ".wav", ".ogg", ".flac",
    ".ttf", ".otf", ".eot", ".woff", ".woff2",
    ".so", ".dll", ".dylib", ".class", ".jar", ".exe", ".bin",
)

# A path is ignored when any of its parts equals one of these.
IGNORED_NAMES = (
    ".git",
    "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".venv", "venv", ".env", "dist", "build", ".egg-info", "target",
)

# Suffix -> language. Anything else has no language.
LANGUAGE_OF_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "bash",
    ".ipynb": "python",
}

# Languages chunked by declaration; other languages go by lines.
STRUCTURED_LANGUAGES = ("python", "typescript", "java", "csharp")

# Label of files without a language, URL prefixes of a valid
# repository, the `source` stamp of every chunk, and the message for no result.
NO_LANGUAGE = "semantic"
REPO_URL_PREFIXES = ("https://github.com/", "git@github.com:")
SOURCE_STAMP = "github"
NO_RESULTS = "No results found for the query."
UNKNOWN_REPO = "Unknown"
LOCAL_ZONE = "Europe/Berlin"


@dataclass(frozen=True)
class IndexParams:
    """Parameters of one indexing job; defaults are the documented ones."""

    max_bytes: int = 50 * 1024
    chunk_lines: int = 40
    chunk_lines_overlap: int = 15
    max_chars: int = 1024
    max_tokens: int = 1024
    token_overlap: int = 64
    declaration_overlap: int = 3
    expand_chunks: bool = False
    # "file": every chunk comes from one file and names it.
    # "group": line windows run over all files of a language; a chunk names the files it
    # has lines of, and the index keeps every path of every group.
    scope: str = "file"
    dim: int = 1536
    batch_size: int = 32
    embed_partitions: int | None = None
    on_error: str = "fail"
    repo_buckets: int = 64

    def __post_init__(self) -> None:
        if self.scope not in ("file", "group"):
            raise ValueError(f"scope must be 'file' or 'group', not {self.scope!r}")
        if self.on_error not in ("fail", "quarantine"):
            raise ValueError(f"on_error must be 'fail' or 'quarantine', not {self.on_error!r}")
        if not 0 <= self.chunk_lines_overlap < self.chunk_lines:
            raise ValueError("chunk_lines_overlap must be below chunk_lines")
        if not 0 <= self.token_overlap < self.max_tokens:
            raise ValueError("token_overlap must be below max_tokens")
        if min(self.max_chars, self.dim, self.batch_size, self.repo_buckets) < 1:
            raise ValueError("max_chars, dim, batch_size and repo_buckets must be positive")
