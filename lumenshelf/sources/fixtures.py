"""The catalogue's tables as views over the supplied parquet tables.

Each view is a base table, a filter and column expressions in the SQL that Spark and DuckDB share, so the
engine and the SQL that checks it start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUS = """CASE WHEN license_id IS NULL OR commercial IS NULL OR modify IS NULL OR redistribute IS NULL OR attribution IS NULL THEN 'unknown'
 WHEN NOT commercial OR NOT modify OR NOT redistribute THEN 'restricted' WHEN attribution THEN 'attribution' ELSE 'permissive' END"""


def rights(key: str) -> dict[str, str]:
    """Licence columns that take every combination of true, false and unknown."""
    return {
        "license_id": f"CASE WHEN {key} % 7 = 0 THEN NULL ELSE concat('lic-', {key} % 5) END",
        "commercial": f"CASE WHEN {key} % 8 = 0 THEN NULL ELSE {key} % 8 <> 1 END",
        "modify": f"CASE WHEN {key} % 10 = 3 THEN NULL ELSE {key} % 10 <> 4 END",
        "redistribute": f"CASE WHEN {key} % 12 = 5 THEN NULL ELSE {key} % 12 <> 6 END",
        "attribution": f"CASE WHEN {key} % 6 = 2 THEN NULL ELSE {key} % 6 < 2 END",
        "holder": f"CASE WHEN {key} % 9 = 0 THEN concat('Studio ', {key} % 4) END",
        "credit": f"CASE WHEN {key} % 14 = 0 THEN concat('by ', {key} % 4) END",
    }


def times(key: str) -> dict[str, str]:
    return {
        "scanned_at": f"1700000000000 + ({key} * 7919 % 100000) * 1000",
        "modified_at": f"CASE WHEN {key} % 11 = 0 THEN NULL ELSE 1690000000000 + ({key} * 104729 % 100000) * 1000 END",
        "analysed_at": f"CASE WHEN {key} % 5 = 0 THEN NULL ELSE 1700000005000 + ({key} * 7919 % 100000) * 1000 END",
        "analysis_version": f"CAST({key} % 4 AS INT)",
        "derivative_version": f"CAST({key} % 5 AS INT)",
        "flags": f"CAST({key} % 4 AS INT)",
    }


ASSET_DOCS = {
    "id": "doc_id * 2",
    "source_id": "source",
    "path": "concat(lang, '/', source, '/', source, '_', lang, '_', doc_id, '.txt')",
    "filename": "concat(source, '_', lang, '_', doc_id, '.txt')",
    "size_bytes": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END",
    "dependency_bytes": "CAST(NULL AS BIGINT)",
    "media_type": "'document'",
    "format": "'txt'",
    "content_hash": "SHA256(coalesce(text, ''))",
    **times("doc_id"),
    **rights("doc_id"),
}
ASSET_PARTS = {
    "id": "p_partkey * 2 + 1",
    "source_id": "concat('src', p_partkey % 20)",
    "path": "concat(p_type, '/Set', p_partkey % 6, '/', replace(p_name, ' ', '_'), '_', p_partkey, '.', CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'wav' WHEN 2 THEN 'glb' ELSE 'mp4' END)",
    "filename": "concat(replace(p_name, ' ', '_'), '_', p_partkey, '.', CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'wav' WHEN 2 THEN 'glb' ELSE 'mp4' END)",
    "size_bytes": "CAST(p_size * 1024 + p_partkey % 3 AS BIGINT)",
    "dependency_bytes": "CASE WHEN p_partkey % 4 = 2 THEN CAST(p_size * 100 AS BIGINT) END",
    "media_type": "CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'model' ELSE 'video' END",
    "format": "CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'wav' WHEN 2 THEN 'glb' ELSE 'mp4' END",
    "content_hash": "SHA256(concat(p_brand, p_type, p_size % 5))",
    **times("p_partkey"),
    **rights("p_partkey"),
}


def tri(key: str, n: int) -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN NULL ELSE {key} % {n} = 1 END"


#: name: (base table or view, filter, columns)
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "asset_docs": ("documents", "TRUE", ASSET_DOCS),
    "asset_parts": ("part", "TRUE", ASSET_PARTS),
    "image_attr": ("part", "p_partkey % 4 = 0", {"asset_id": "p_partkey * 2 + 1", "width": "256 * (1 + p_size % 16)", "height": "CAST(128 * (1 + p_partkey % 20) AS INT)", "color_depth": "CAST(8 * (1 + p_partkey % 3) AS INT)", "has_alpha": tri("p_partkey", 3), "color_space": "CASE p_partkey % 5 WHEN 0 THEN 'sRGB' WHEN 1 THEN 'srgb' WHEN 2 THEN 'Linear' WHEN 3 THEN 'SRGB' END", "tileability": "(p_partkey % 100) / 100.0e0", "repeat_period": "CAST(p_partkey % 64 AS INT)", "tile_class": "CASE p_partkey % 3 WHEN 0 THEN 'Seamless' WHEN 1 THEN 'none' ELSE 'seamless' END", "mip_levels": "CAST(1 + p_partkey % 12 AS INT)", "class": "CASE p_partkey % 3 WHEN 0 THEN 'texture' WHEN 1 THEN 'sprite' ELSE 'photo' END"}),
    "audio_attr": ("part", "p_partkey % 4 = 1", {"asset_id": "p_partkey * 2 + 1", "duration_ms": "p_size * 1500 + p_partkey % 977", "sample_rate": "CASE WHEN p_partkey % 3 = 0 THEN 44100 ELSE 48000 END", "bit_depth": "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 16 ELSE 24 END", "channels": "CAST(1 + p_partkey % 2 AS INT)", "bpm": "60.0e0 + p_partkey % 120", "musical_key": "CASE p_partkey % 3 WHEN 0 THEN 'Am' WHEN 1 THEN 'C' ELSE 'am' END", "loudness_lufs": "-30.0e0 + p_partkey % 25", "brightness": "(p_partkey % 50) / 50.0e0", "harmonicity": "(p_partkey % 40) / 40.0e0", "codec": "CASE p_partkey % 3 WHEN 0 THEN 'PCM' WHEN 1 THEN 'pcm' ELSE 'flac' END", "container": "CASE p_partkey % 8 WHEN 1 THEN 'RIFF' ELSE 'wav' END", "class": "CASE p_partkey % 2 WHEN 0 THEN 'music' ELSE 'sfx' END"}),
    "model_attr": ("part", "p_partkey % 4 = 2", {"asset_id": "p_partkey * 2 + 1", "vertex_count": "p_size * 700 + p_partkey % 31", "triangle_count": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size * p_size * 30 END", "mesh_count": "CAST(1 + p_partkey % 7 AS INT)", "material_count": "CAST(p_partkey % 9 AS INT)", "texture_count": "CAST(p_partkey % 5 AS INT)", "has_rig": tri("p_partkey", 5), "has_animation": tri("p_partkey", 9), "has_uv": tri("p_partkey", 7), "dependency_bytes": "CAST(p_size * 100 AS BIGINT)", "class": "'prop'"}),
    "video_attr": ("part", "p_partkey % 4 = 3", {"asset_id": "p_partkey * 2 + 1", "duration_ms": "p_size * 2100 + p_partkey % 977", "width": "CASE WHEN p_partkey % 3 = 0 THEN 3840 WHEN p_partkey % 3 = 1 THEN 1920 ELSE 640 END", "height": "CASE WHEN p_partkey % 3 = 0 THEN 2160 WHEN p_partkey % 3 = 1 THEN 1080 ELSE 480 END", "fps": "CASE WHEN p_partkey % 2 = 0 THEN 30.0e0 ELSE 60.0e0 END", "bitrate": "p_size * 100000", "codec": "CASE WHEN p_partkey % 2 = 0 THEN 'h264' ELSE 'av1' END", "container": "'mp4'", "has_audio": tri("p_partkey", 3), "class": "'clip'"}),
    "document_attr": ("documents", "TRUE", {"asset_id": "doc_id * 2", "page_count": "CAST(floor(n_chars / 1800e0) AS BIGINT)", "word_count": "CAST(floor(n_chars / 6e0) AS BIGINT)", "author": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('Author ', doc_id % 7) END", "title": "concat('Doc ', doc_id)", "encoding": "'UTF-8'", "excerpt": "substr(text, 1, 280)", "class": "CASE WHEN lang = 'en' THEN 'document' ELSE 'readme' END"}),
    "tag": ("nation", "TRUE", {"tag_id": "CAST(n_nationkey AS BIGINT)", "name": "CASE n_nationkey WHEN 1 THEN 'Texture' WHEN 2 THEN 'music' WHEN 3 THEN 'prop' WHEN 4 THEN 'clip' WHEN 5 THEN 'document' WHEN 6 THEN 'sprite' ELSE lower(n_name) END"}),
    "collection": ("region", "TRUE", {"collection_id": "CAST(r_regionkey AS BIGINT)", "name": "r_name", "kind": "'manual'"}),
}
#: Views over other views, as SQL that both engines read; the views it reads stand in braces.
DERIVED: dict[str, str] = {
    "asset": f"SELECT *, {STATUS} AS license_status FROM (SELECT * FROM {{asset_docs}} UNION ALL SELECT * FROM {{asset_parts}}) AS both_kinds",
    "asset_tag": "SELECT asset_id, tag_id, CASE (asset_id + tag_id) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suggested' ELSE 'rejected' END AS state, CASE WHEN asset_id % 2 = 0 THEN 'user' ELSE 'auto' END AS source, CAST(0.5e0 + (asset_id % 5) / 10e0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT asset_id, tag_id FROM (SELECT id AS asset_id, id * 7 % 25 AS tag_id FROM {asset} UNION ALL SELECT id, (id * 13 + 3) % 25 FROM {asset} UNION ALL SELECT id, (id * 3 + 1) % 9 FROM {asset}) AS picks) AS pairs",
    "collection_member": "SELECT id % 5 AS collection_id, id AS asset_id, id * 31 % 1000 AS added_at FROM {asset} WHERE id % 3 = 0",
    "source_table": "SELECT source_id, concat('Source ', substr(source_id, 4, 1)) AS name, CASE WHEN source_id = 'src7' THEN 'federated' ELSE 'local_fs' END AS kind, concat('secret-', source_id) AS connection FROM (SELECT DISTINCT source_id FROM {asset} UNION ALL SELECT 'src99') AS ids",
    "pending_ingest": "SELECT source_id, path, size_bytes AS size, modified_at AS mtime, CAST(id % 3 AS INT) AS revision, CASE WHEN id % 2 = 0 THEN NULL ELSE 1700000000000 + id % 50 END AS retry_after, CAST(id % 4 AS INT) AS attempts FROM {asset} WHERE id % 13 = 0",
    "blocklist": "SELECT DISTINCT content_hash FROM {asset} WHERE id % 97 = 0",
    "asset_note": "SELECT id AS asset_id, concat('note ', id % 10) AS body FROM {asset} WHERE id % 6 = 0",
}


class Catalog:
    """The catalogue's tables of one data folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.make(name)
        return self._made[name]

    def make(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, where, columns = VIEWS[name]
            picked = [f"{spark_expression(e)} AS {c}" for c, e in columns.items()]
            return self.base(base).where(where).selectExpr(*picked)
        if name in DERIVED:
            sql = DERIVED[name]
            return self.spark.sql(sql, **{t: getattr(self, t) for t in ("asset_docs", "asset_parts", "asset") if f"{{{t}}}" in sql})
        return self.base(name)


def spark_expression(expression: str) -> str:
    if expression.startswith("SHA256("):
        return f"sha2({expression[len('SHA256(') : -1]}, 256)"
    return expression


def prelude() -> str:
    """The views as common table expressions for DuckDB."""
    parts = []
    for name, (base, where, columns) in VIEWS.items():
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {base} WHERE {where})")
    parts += [f"{name} AS ({sql.format(asset_docs='asset_docs', asset_parts='asset_parts', asset='asset')})" for name, sql in DERIVED.items()]
    return "WITH " + ",\n".join(parts)


PRELUDE = prelude()


def oracle(body: str) -> str:
    """A DuckDB query over the views."""
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"{PRELUDE.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{body.lstrip()[len('WITH RECURSIVE ') :]}"
    return f"{PRELUDE}\n{body}" if not body.lstrip().upper().startswith("WITH ") else f"{PRELUDE},\n{body.lstrip()[5:]}"
