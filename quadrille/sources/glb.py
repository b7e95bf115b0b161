"""Binary glTF: containers, accessors, meshes, points, splats, features and metadata, as typed rows.

``decode_tiles`` runs one Arrow function over (tile key, content) rows.  What can't be read as plain
geometry is declined with a reason and no rows are lost: errors and reasons are columns.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quadrille.sources import meshopt

#: glTF's component types and element sizes.
_COMPONENT = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
#: Levels of nodes below a scene; metres from which a root's offset is planetary.
MOST_DEPTH, PLANETARY = 256, 1e6
_MESHOPT = ("EXT_meshopt_compression", "KHR_meshopt_compression")
#: Extensions that decoding deals with, so a document that requires them can be read.
_HANDLED = {"CESIUM_RTC", "EXT_mesh_features", "EXT_structural_metadata", "KHR_mesh_quantization", "KHR_texture_basisu", "KHR_materials_unlit", "KHR_gaussian_splatting", *_MESHOPT}


class GlbError(ValueError):
    pass


class Declined(Exception):
    """The content is sound but beyond plain extraction."""


def split(content: bytes) -> tuple[bytes, bytes | None]:
    """(JSON, binary chunk or None); content without the magic is bare JSON; of several chunks of a kind the last counts."""
    if content[:4] != b"glTF":
        return content, None
    if len(content) < 12:
        raise GlbError("the header is cut off")
    text, blob, at = None, None, 12
    while at + 8 <= len(content):
        size, kind = struct.unpack_from("<I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise GlbError("a chunk runs past the end")
        if kind == b"JSON":
            text = body
        elif kind == b"BIN\0":
            blob = body
        at += 8 + size
    if text is None:
        raise GlbError("no JSON chunk")
    return text, blob


def assemble(text: bytes, blob: bytes = b"") -> bytes:
    """A container: JSON padded with spaces, binary with zeros and left out if empty."""
    text += b" " * (-len(text) % 4)
    blob += bytes(-len(blob) % 4)
    chunks = struct.pack("<I4s", len(text), b"JSON") + text + (struct.pack("<I4s", len(blob), b"BIN\0") + blob if blob else b"")
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks


def quaternion_matrix(q: list[float]) -> np.ndarray:
    x, y, z, w = q
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return out


def node_matrix(node: dict[str, Any]) -> np.ndarray:
    """matrix, or translation x rotation x scale; ill-formed members are declined."""

    def floats(name: str, default: list[float]) -> list[float]:
        value = node.get(name, default)
        if not isinstance(value, list) or len(value) != len(default) or not all(isinstance(x, (int, float)) for x in value):
            raise Declined(f"an ill-formed {name}")
        return [float(x) for x in value]

    if "matrix" in node:
        return np.array(floats("matrix", [0.0] * 16)).reshape(4, 4).T
    out = quaternion_matrix(floats("rotation", [0, 0, 0, 1]))
    out[:3, :3] = out[:3, :3] * floats("scale", [1, 1, 1])
    out[:3, 3] = floats("translation", [0, 0, 0])
    return out


@dataclass
class Document:
    json: dict[str, Any]
    blob: bytes | None
    views: dict[int, bytes] = field(default_factory=dict)

    @classmethod
    def of(cls, content: bytes) -> Document:
        text, blob = split(content)
        try:
            value = json.loads(text)
        except ValueError as error:
            raise GlbError(f"no JSON: {error}") from error
        if not isinstance(value, dict):
            raise GlbError("the JSON is no object")
        return cls(value, blob)

    def part(self, kind: str, at: Any) -> dict[str, Any]:
        items = self.json.get(kind, [])
        if not isinstance(at, int) or not 0 <= at < len(items):
            raise GlbError(f"no {kind} {at}")
        return items[at]

    def _slice(self, spec: dict[str, Any]) -> bytes:
        start, size = spec.get("byteOffset", 0), spec["byteLength"]
        if spec.get("buffer", 0) != 0 or self.blob is None:
            raise GlbError("only the binary chunk is read")
        out = self.blob[start : start + size]
        if len(out) < size:
            raise GlbError("a buffer view runs past its buffer")
        return out

    def view(self, at: int) -> bytes:
        """A buffer view's bytes, decompressed once."""
        if at not in self.views:
            spec = self.part("bufferViews", at)
            packed = next((e[n] for n in _MESHOPT if n in (e := spec.get("extensions", {}))), None)
            self.views[at] = meshopt.decode(packed["mode"], packed.get("filter", "NONE"), packed["count"], packed["byteStride"], self._slice(packed)) if packed else self._slice(spec)
        return self.views[at]

    def accessor(self, at: int) -> np.ndarray:
        """Rows of an accessor in its own type; strides are followed, sparse ones refused."""
        spec = self.part("accessors", at)
        if "sparse" in spec:
            raise GlbError("sparse accessors aren't read")
        kind, width = np.dtype(_COMPONENT.get(spec.get("componentType"), "V0") or "V0"), _WIDTH.get(spec.get("type"), 0)
        if not kind.itemsize or not width:
            raise GlbError("an unknown accessor type")
        count = spec.get("count", 0)
        if "bufferView" not in spec:
            return np.zeros((count, width), kind)
        view = self.part("bufferViews", spec["bufferView"])
        packed = next((e[n] for n in _MESHOPT if n in (e := view.get("extensions", {}))), {})
        own = kind.itemsize * width
        stride = packed.get("byteStride") or view.get("byteStride") or own
        raw, start = self.view(spec["bufferView"]), spec.get("byteOffset", 0)
        if count and start + (count - 1) * stride + own > len(raw):
            raise GlbError("an accessor runs past its view")
        return np.ndarray((count, width), kind, raw, start, (stride, kind.itemsize)).copy()

    def floats(self, at: int) -> np.ndarray:
        """An accessor as floats; normalised integers become fractions."""
        values = self.accessor(at)
        if values.dtype.kind != "f" and self.part("accessors", at).get("normalized"):
            return np.maximum(values.astype(np.float32) / np.float32(np.iinfo(values.dtype).max), np.float32(-1))
        return values.astype(np.float32)

    def indices(self, at: int) -> np.ndarray:
        values = self.accessor(at)
        if values.dtype.kind != "u" or values.shape[1] != 1:
            raise GlbError("indices are unsigned scalars")
        return values[:, 0].astype(np.int64)

    def roots(self) -> list[int]:
        scenes = self.json.get("scenes")
        return self.part("scenes", self.json.get("scene", 0)).get("nodes", []) if scenes else list(range(len(self.json.get("nodes", []))))

    def rtc_center(self) -> list[float] | None:
        return self.json.get("extensions", {}).get("CESIUM_RTC", {}).get("center")

    def planetary_offset(self) -> list[float] | None:
        """The first root's translation, if it is planetary."""
        for at in self.roots():
            moved = node_matrix(self.part("nodes", at))[:3, 3]
            if np.linalg.norm(moved) > PLANETARY:
                return moved.tolist()
        return None

    def materials(self) -> list[dict[str, Any]]:
        out = []
        for m in self.json.get("materials", []):
            pbr = m.get("pbrMetallicRoughness", {})
            out.append({"base_color": [float(x) for x in pbr.get("baseColorFactor", [1, 1, 1, 1])], "metallic": float(pbr.get("metallicFactor", 1)), "roughness": float(pbr.get("roughnessFactor", 1)), "double_sided": bool(m.get("doubleSided", False)), "unlit": "KHR_materials_unlit" in m.get("extensions", {})})
        return out

    def feature_paths(self) -> list[str]:
        """nodePath of each feature of the first property table; an ill-formed table costs the paths only."""
        try:
            rows = self.json["extensions"]["EXT_structural_metadata"]["propertyTables"][0]
            column, n = rows["properties"]["nodePath"], rows["count"]
            ends = np.frombuffer(self.view(column["stringOffsets"]), "<u4", n + 1)
            raw = self.view(column["values"])
            if n and ends[-1] > len(raw):
                return []
            return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        except (KeyError, IndexError, TypeError, ValueError):
            return []

    def walk(self, offset: list[float] | None):
        """(node, world matrix) depth first."""
        todo = [(at, np.eye(4), 0) for at in reversed(self.roots())]
        while todo:
            at, above, depth = todo.pop()
            if depth > MOST_DEPTH:
                raise GlbError(f"nodes are nested deeper than {MOST_DEPTH}")
            node = self.part("nodes", at)
            own = node_matrix(node)
            if offset is not None and depth == 0:
                own[:3, 3] -= offset
            yield node, above @ own
            todo += [(c, above @ own, depth + 1) for c in reversed(node.get("children", []))]


_F3 = "array<array<float>>"
TILE = (
    "error string, declined string, rtc_center array<double>, copyright string, node_paths array<string>, materials array<struct<base_color:array<double>,metallic:double,roughness:double,double_sided:boolean,unlit:boolean>>, "
    f"primitives array<struct<kind:string,mesh:int,prim:int,material:int,transform:array<double>,positions:{_F3},normals:{_F3},uvs:{_F3},colors:{_F3},indices:array<bigint>,features:array<float>,rotations:{_F3},scales:{_F3}>>"
)


def _splat(doc: Document, prim: dict[str, Any]) -> dict[str, Any]:
    """Gaussians: positions, colours with opacity in the fourth place, w-first rotations, scales; padded to a multiple of 32."""
    at, pre = prim["attributes"], "KHR_gaussian_splatting:"
    get = lambda *names: next((doc.floats(at[n]) for n in names if n in at), None)
    positions, rotation, scale = doc.floats(at["POSITION"]), get(pre + "ROTATION", "_ROTATION"), get(pre + "SCALE", "_SCALE")
    opacity, flat, color = get(pre + "OPACITY", "_OPACITY"), get(pre + "SH_DEGREE_0_COEF_0"), get("COLOR_0")
    n = len(positions)
    rgb = flat if flat is not None else (color[:, :3] - 0.5) / 0.28209479177387814 if color is not None else np.zeros((n, 3))
    alpha = opacity[:, 0] if opacity is not None else color[:, 3] if color is not None and color.shape[1] == 4 else np.ones(n)
    turns = np.roll(rotation, 1, axis=1) if rotation is not None else np.tile([1.0, 0, 0, 0], (n, 1))
    pad = -n % 32
    fill = lambda a: np.concatenate([a, np.zeros((pad, a.shape[1]))]).astype(np.float32)
    return {"kind": "splats", "positions": fill(positions), "colors": fill(np.column_stack([rgb, np.clip(alpha, 0, 1)])), "rotations": fill(turns), "scales": fill(scale if scale is not None else np.ones((n, 3)))}


def _primitive(doc: Document, prim: dict[str, Any]) -> dict[str, Any]:
    extensions, attributes = prim.get("extensions", {}), prim.get("attributes", {})
    if "KHR_draco_mesh_compression" in extensions:
        raise Declined("a Draco primitive needs a decoder of its own")
    if "POSITION" not in attributes:
        raise Declined("a primitive without positions")
    if any(n.startswith("KHR_gaussian_splatting") for n in extensions):
        return _splat(doc, prim)
    mode = prim.get("mode", 4)
    get = lambda name: doc.floats(attributes[name]) if name in attributes else None
    positions, colors = doc.floats(attributes["POSITION"]), get("COLOR_0")
    if colors is not None and colors.shape[1] == 3:
        colors = np.column_stack([colors, np.ones(len(colors), np.float32)])
    if mode == 0:
        return {"kind": "points", "positions": positions, "colors": colors if colors is not None else np.ones((len(positions), 4), np.float32)}
    if mode != 4:
        raise Declined("a primitive that is no triangle list")
    material = prim.get("material")
    if material is not None and not (isinstance(material, int) and 0 <= material < len(doc.json.get("materials", []))):
        raise Declined("a material that doesn't exist")
    ids = extensions.get("EXT_mesh_features", {}).get("featureIds", [])
    name = f"_FEATURE_ID_{ids[0]['attribute']}" if ids and "attribute" in ids[0] else None
    features = None
    if name is not None:
        if name not in attributes:
            raise GlbError(f"no attribute {name}")
        features = doc.floats(attributes[name])[:, 0]
    return {"kind": "mesh", "material": material, "positions": positions, "normals": get("NORMAL"), "uvs": get("TEXCOORD_0"), "colors": colors, "indices": doc.indices(prim["indices"]) if "indices" in prim else None, "features": features}


def parsed(content: bytes, georeferenced: bool = False) -> dict[str, Any]:
    """One tile's content as a row of TILE whose vertex data are arrays."""
    out: dict[str, Any] = dict.fromkeys(("error", "declined", "rtc_center", "copyright"), None) | {"node_paths": [], "materials": [], "primitives": []}
    try:
        doc = Document.of(content)
        out["copyright"] = doc.json.get("asset", {}).get("copyright")
        if unknown := set(doc.json.get("extensionsRequired", [])) - _HANDLED:
            raise Declined(f"requires {sorted(unknown)[0]}")
        center = doc.rtc_center()
        offset = doc.planetary_offset() if georeferenced and center is None else None
        out["rtc_center"] = [float(x) for x in center] if center is not None else offset
        out["node_paths"], out["materials"] = doc.feature_paths(), doc.materials()
        rows = []
        for node, world in doc.walk(offset):
            if "mesh" not in node:
                continue
            for k, prim in enumerate(doc.part("meshes", node["mesh"]).get("primitives", [])):
                got = _primitive(doc, prim)
                row = dict.fromkeys(("material", "normals", "uvs", "colors", "indices", "features", "rotations", "scales"))
                rows.append(row | got | {"mesh": node["mesh"], "prim": k, "transform": world.T.reshape(-1)})
        out["primitives"] = rows
    except Declined as reason:
        out["declined"] = str(reason)
    except (GlbError, meshopt.MeshoptError, KeyError, TypeError, IndexError, AttributeError) as error:
        out["error"] = f"{type(error).__name__}: {error}"
    return out


def decode(content: bytes, georeferenced: bool = False) -> dict[str, Any]:
    """One tile's content as a row of TILE."""
    row = parsed(content, georeferenced)
    return row | {"primitives": [{n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in p.items()} for p in row["primitives"]]}


def _arrow(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column from arrays of one or two dimensions, without a Python object for each number; None is null."""
    some = [v for v in values if v is not None]
    inner = kind.value_type
    flat = np.concatenate([v.reshape(-1) for v in some]) if some else np.zeros(0)
    item = pa.array(flat.astype((inner.value_type if pa.types.is_list(inner) else inner).to_pandas_dtype(), copy=False))
    if pa.types.is_list(inner):
        widths = np.concatenate([np.full(len(v), v.shape[1]) for v in some]) if some else np.zeros(0, np.int64)
        item = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)), item)
    offs = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), item, mask=pa.array([v is None for v in values], pa.bool_())) if values else pa.array([], kind)


def _batch(rows: list[dict[str, Any]], schema: pa.Schema) -> list[pa.Array]:
    """Columns of TILE."""
    out = []
    for f in schema:
        if f.name != "primitives":
            out.append(pa.array([r[f.name] for r in rows], f.type))
            continue
        every = [p for r in rows for p in r["primitives"]]
        columns = [_arrow([p[c.name] for p in every], c.type) if pa.types.is_list(c.type) else pa.array([p[c.name] for p in every], c.type) for c in f.type.value_type]
        offs = np.concatenate([[0], np.cumsum([len(r["primitives"]) for r in rows])]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays(columns, fields=list(f.type.value_type))))
    return out


def decode_tiles(tiles: DataFrame, *keys: str, georeferenced: bool = False) -> DataFrame:
    """``keys`` of (…, content) rows and TILE's columns; vertex data pass as Arrow buffers."""
    own = StructType.fromDDL(TILE)
    schema = StructType([*tiles.select(*keys).schema.fields, *own.fields])
    shape = to_arrow_schema(own)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # decoded tiles are several times their content
                part = batch.slice(k, 16)
                rows = [parsed(c or b"", georeferenced) for c in part.column("content").to_pylist()]
                yield pa.record_batch([*(part.column(n) for n in keys), *_batch(rows, shape)], names=[*keys, *shape.names])

    from quadrille.ship import ship

    ship(tiles.sparkSession)
    return tiles.select(*keys, "content").mapInArrow(run, schema)


def tables(decoded: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """vertices, triangles and ids of decoded meshes, as operators on geometry take them."""
    each = decoded.selectExpr(*keys, "inline(primitives)").where("kind = 'mesh'")
    own = (*keys, "mesh", "prim")
    vertices = each.selectExpr(*own, "posexplode(positions) AS (vertex, p)").selectExpr(*own, "cast(vertex AS bigint) AS vertex", "p[0] AS x", "p[1] AS y", "p[2] AS z")
    order = "coalesce(indices, transform(sequence(0, size(positions) - 1), i -> cast(i AS bigint)))"
    corners = each.selectExpr(*own, f"{order} AS o").selectExpr(*own, "posexplode(transform(sequence(0, (size(o) div 3) - 1), t -> slice(o, 3 * t + 1, 3))) AS (triangle, v)")
    triangles = corners.selectExpr(*own, "cast(triangle AS bigint) AS triangle", "v[0] AS v0", "v[1] AS v1", "v[2] AS v2")
    ids = each.where("features is not null").selectExpr(*own, "posexplode(features) AS (vertex, feature)").selectExpr(*own, "cast(vertex AS bigint) AS vertex", "cast(feature AS double) AS feature")
    return {"vertices": vertices, "triangles": triangles, "ids": ids}
