"""Table definitions for external stores."""

from __future__ import annotations

HALF_ABOVE = 2000  # an HNSW index takes full vectors up to this size


def _name(name: str) -> str:
    if not name.replace("_", "").isalnum() or name[0].isdigit():
        raise ValueError(f"{name!r} is no plain table name")
    return name


def vector_type(dims: int) -> str:
    """The pgvector column type for vectors of a size."""
    if dims <= 0:
        raise ValueError("vectors have one dimension or more")
    return f"{'halfvec' if dims > HALF_ABOVE else 'vector'}({dims})"


def postgres_ddl(table: str, dims: int, m: int = 16, ef: int = 64) -> list[str]:
    """Statements for a table of chunks with a vector, a text search and a metadata index."""
    t, kind = _name(table), vector_type(dims)
    ops = "halfvec_cosine_ops" if kind.startswith("halfvec") else "vector_cosine_ops"
    return [
        "CREATE EXTENSION IF NOT EXISTS vector",
        f"CREATE TABLE IF NOT EXISTS {t} (id text PRIMARY KEY, collection text NOT NULL, body text NOT NULL, metadata jsonb NOT NULL DEFAULT '{{}}', embedding {kind}, words tsvector GENERATED ALWAYS AS (to_tsvector('simple', body)) STORED)",
        f"CREATE INDEX IF NOT EXISTS {t}_embedding ON {t} USING hnsw (embedding {ops}) WITH (m = {m}, ef_construction = {ef})",
        f"CREATE INDEX IF NOT EXISTS {t}_words ON {t} USING gin (words)",
    ]


def mysql_ddl(table: str) -> list[str]:
    """The same for MySQL, where vectors are stored as JSON."""
    t = _name(table)
    return [f"CREATE TABLE IF NOT EXISTS {t} (id varchar(255) PRIMARY KEY, collection varchar(255) NOT NULL, body longtext NOT NULL, metadata json, embedding json, FULLTEXT KEY {t}_words (body), KEY {t}_collection (collection))"]


def atlas_index(dims: int, path: str = "embedding") -> dict:
    """A vector search index with filters on collection and document."""
    fields = [{"type": "vector", "path": path, "numDimensions": dims, "similarity": "cosine"}]
    return {"fields": fields + [{"type": "filter", "path": p} for p in ("collection", "document_id")]}
