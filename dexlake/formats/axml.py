"""Binary XML as flat nodes and attributes, and the manifest read from it."""

from __future__ import annotations

import struct

from dexlake.formats.binary import NO_INDEX, FormatError, part, u16, u32

# Fixed values of the format: chunk types, value types.
STRINGS, XML, START_NS, END_NS, START, END, CDATA = 0x0001, 0x0003, 0x0100, 0x0101, 0x0102, 0x0103, 0x0104
UTF8_FLAG = 0x100
REFERENCE, ATTRIBUTE, STRING, FLOAT, DEC, HEX, BOOL = 0x01, 0x02, 0x03, 0x04, 0x10, 0x11, 0x12
ANDROID = "http://schemas.android.com/apk/res/android"
DEEPEST, MOST_STRINGS = 256, 1 << 20


def string_pool(data: bytes, at: int) -> list[str]:
    """Strings of a pool chunk; one that can't be read is empty."""
    if u16(data, at) != STRINGS:
        raise FormatError("no string pool")
    header, size, count, flags, start = u16(data, at + 2), u32(data, at + 4), u32(data, at + 8), u32(data, at + 16), u32(data, at + 20)
    if count > MOST_STRINGS:
        raise FormatError(f"{count} strings")
    part(data, at, size)
    found = []

    def short(p: int) -> tuple[int, int]:
        n = data[p]
        return ((n & 0x7F) << 8 | data[p + 1], p + 2) if n & 0x80 else (n, p + 1)

    for i in range(count):
        p = at + start + u32(data, at + header + 4 * i)
        try:
            if flags & UTF8_FLAG:
                _, p = short(p)
                n, p = short(p)
                found.append(part(data, p, n).decode("utf-8", "replace"))
            else:
                n, p = u16(data, p), p + 2
                if n & 0x8000:
                    n, p = (n & 0x7FFF) << 16 | u16(data, p), p + 2
                found.append(part(data, p, 2 * n).decode("utf-16-le", "replace"))
        except (FormatError, IndexError):
            found.append("")
    return found


def typed(kind: int, value: int, strings: list[str]) -> str:
    """A typed value as text."""
    if kind == STRING:
        return strings[value] if value < len(strings) else ""
    if kind == DEC:
        return str(value - (1 << 32) if value >> 31 else value)
    if kind == BOOL:
        return "true" if value else "false"
    if kind == FLOAT:
        return repr(struct.unpack("<f", value.to_bytes(4, "little"))[0])
    return {REFERENCE: "@0x%08x", ATTRIBUTE: "?0x%08x"}.get(kind, "0x%08x") % value


def nodes(data: bytes) -> list[dict]:
    """Elements and texts in document order: node_id, parent_id, ord, kind, ns, name, text and attrs (ns, name, kind, value, text)."""
    if u16(data, 0) != XML:
        raise FormatError("no binary XML")
    end = min(len(data), u32(data, 4))
    at, strings, found, open_, counts = u16(data, 2), [], [], [], {-1: 0}

    def name(i: int) -> str | None:
        if i == NO_INDEX:
            return None
        if i >= len(strings):
            raise FormatError(f"string {i} of {len(strings)}")
        return strings[i]

    def node(kind: str, **more) -> dict:
        above = open_[-1] if open_ else -1
        row = {"node_id": len(found), "parent_id": above, "ord": counts[above], "kind": kind, "ns": None, "name": None, "text": None, "attrs": []} | more
        counts[above] += 1
        counts[row["node_id"]] = 0
        found.append(row)
        return row

    while at + 8 <= end:
        kind, header, size = u16(data, at), u16(data, at + 2), u32(data, at + 4)
        if size < 8 or at + size > len(data):
            raise FormatError(f"chunk of {size} bytes at {at}")
        body = at + header
        if kind == STRINGS:
            strings = string_pool(data, at)
        elif kind == START:
            if len(open_) >= DEEPEST:
                raise FormatError("elements nest too deep")
            first, step, n = body + u16(data, body + 8), u16(data, body + 10), u16(data, body + 12)
            attrs = []
            for p in range(first, first + n * step, max(step, 20)):
                vk, value = data[p + 15], u32(data, p + 16)
                raw = u32(data, p + 8)
                attrs.append({"ns": name(u32(data, p)), "name": name(u32(data, p + 4)), "kind": vk, "value": value, "text": strings[raw] if vk == STRING and raw < len(strings) else typed(vk, value, strings)})
            open_.append(node("element", ns=name(u32(data, body)), name=name(u32(data, body + 4)), attrs=attrs)["node_id"])
        elif kind == END:
            if not open_:
                raise FormatError("an element ends that didn't begin")
            open_.pop()
        elif kind == CDATA:
            node("text", text=name(u32(data, body)))
        at += size
    return found


def xml_text(found: list[dict]) -> str:
    """Nodes as indented XML."""
    below: dict[int, list[dict]] = {}
    for n in found:
        below.setdefault(n["parent_id"], []).append(n)
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out: list[str] = []

    def put(n: dict, deep: int) -> None:
        pad = "  " * deep
        if n["kind"] == "text":
            out.append(pad + esc(n["text"] or ""))
            return
        attrs = "".join(f' {"android:" if a["ns"] == ANDROID else ""}{a["name"]}="{esc(a["text"]).replace(chr(34), "&quot;")}"' for a in n["attrs"])
        inner = below.get(n["node_id"], [])
        out.append(f"{pad}<{n['name']}{attrs}{'' if inner else '/'}>")
        for x in inner:
            put(x, deep + 1)
        if inner:
            out.append(f"{pad}</{n['name']}>")

    for root in below.get(-1, []):
        put(root, 0)
    return "\n".join(out)


def write_pool(strings: list[str]) -> bytes:
    """A string pool chunk of UTF-16 strings below 32,768 units."""
    data, offs = bytearray(), []
    for s in strings:
        raw = s.encode("utf-16-le")
        offs.append(len(data))
        data += struct.pack("<H", len(raw) // 2) + raw + b"\0\0"
    data += b"\0" * (-len(data) % 4)
    start = 28 + 4 * len(strings)
    return struct.pack("<HHIIIIII", STRINGS, 28, start + len(data), len(strings), 0, 0, start, 0) + struct.pack(f"<{len(offs)}I", *offs) + bytes(data)


def write(root: tuple) -> bytes:
    """Binary XML of (name, {attribute: value}, [children]); attributes have the Android namespace unless they begin with ":"."""
    strings: dict[str, int] = {ANDROID: 0}

    def sid(s: str) -> int:
        return strings.setdefault(s, len(strings))

    body = bytearray()

    def chunk(kind: int, content: bytes) -> None:
        body.extend(struct.pack("<HHIII", kind, 16, 16 + len(content), 1, NO_INDEX) + content)

    def element(e: tuple) -> None:
        name, attrs, children = e
        raw = b""
        for k, v in attrs.items():
            ns, k = (NO_INDEX, k[1:]) if k.startswith(":") else (0, k)
            if isinstance(v, bool):
                t = (NO_INDEX, BOOL, NO_INDEX if v else 0)
            elif isinstance(v, int):
                t = (NO_INDEX, DEC, v & NO_INDEX)
            else:
                t = (sid(v), STRING, sid(v))
            raw += struct.pack("<IIIHBBI", ns, sid(k), t[0], 8, 0, t[1], t[2])
        chunk(START, struct.pack("<IIHHHHHH", NO_INDEX, sid(name), 20, 20, len(attrs), 0, 0, 0) + raw)
        for c in children:
            if isinstance(c, str):
                chunk(CDATA, struct.pack("<IHBBI", sid(c), 8, 0, STRING, sid(c)))
            else:
                element(c)
        chunk(END, struct.pack("<II", NO_INDEX, sid(name)))

    element(root)
    pool = write_pool(list(strings))
    return struct.pack("<HHI", XML, 8, 8 + len(pool) + len(body)) + pool + bytes(body)


COMPONENTS = {"activity": "activity", "activity-alias": "activity-alias", "service": "service", "receiver": "receiver", "provider": "provider"}
DATA_KEYS = {"scheme": "scheme", "host": "host", "port": "port", "path": "path", "pathPrefix": "path_prefix", "pathSuffix": "path_suffix", "pathPattern": "path_pattern", "pathAdvancedPattern": "path_advanced_pattern", "mimeType": "mime_type"}
PERMISSIONS = {"uses-permission": "uses", "uses-permission-sdk-23": "uses-sdk-23", "permission": "declares"}
GROUP_PARTS = {"path": ("path", "exact"), "pathPrefix": ("path", "prefix"), "pathSuffix": ("path", "suffix"), "pathPattern": ("path", "pattern"), "pathAdvancedPattern": ("path", "advanced"), "query": ("query", "exact"), "queryPrefix": ("query", "prefix"), "querySuffix": ("query", "suffix"), "queryPattern": ("query", "pattern"), "queryAdvancedPattern": ("query", "advanced"), "fragment": ("fragment", "exact"), "fragmentPrefix": ("fragment", "prefix"), "fragmentSuffix": ("fragment", "suffix"), "fragmentPattern": ("fragment", "pattern"), "fragmentAdvancedPattern": ("fragment", "advanced")}


def manifest(data: bytes) -> dict:
    """The manifest: package, versions, application flags, permissions, features and components with their filters."""
    found = nodes(data)
    below: dict[int, list[dict]] = {}
    for n in found:
        if n["kind"] == "element":
            below.setdefault(n["parent_id"], []).append(n)
    inner = lambda n, *names: [x for x in below.get(n["node_id"], []) if x["name"] in names]

    def get(n: dict, key: str) -> str | None:
        """The first attribute of that name without a namespace or with Android's."""
        return next((a["text"] for a in n["attrs"] if a["name"] == key and a["ns"] in (None, "", ANDROID)), None)

    def number(n: dict, key: str) -> int | None:
        v = get(n, key)
        try:
            return int(v, 0) if v is not None else None
        except ValueError:
            return None

    def flag(n: dict, key: str) -> bool | None:
        return {"true": True, "false": False}.get(get(n, key))

    root = next((n for n in found if n["kind"] == "element"), None)
    if root is None or root["name"] != "manifest":
        raise FormatError("no manifest element")
    sdk = next(iter(inner(root, "uses-sdk")), None)
    app = next(iter(inner(root, "application")), None)
    low, target = (number(sdk, "minSdkVersion"), number(sdk, "targetSdkVersion")) if sdk else (None, None)
    out = {
        "package": get(root, "package"), "version_code": number(root, "versionCode"), "version_name": get(root, "versionName"), "min_sdk": low, "target_sdk": target,
        "effective_target": target or low or 1, "split": get(root, "split"), "required_splits": get(root, "requiredSplitTypes") is not None or flag(root, "isSplitRequired") is True,
        "permissions": [{"kind": PERMISSIONS[n["name"]], "name": get(n, "name")} for n in inner(root, *PERMISSIONS)],
        "features": [{"name": get(n, "name"), "required": flag(n, "required") is not False} for n in inner(root, "uses-feature")],
        "queries": [{"kind": x["name"], "name": get(x, "name") or get(x, "authorities")} for q in inner(root, "queries") for x in below.get(q["node_id"], [])],
        "debuggable": flag(app, "debuggable") if app else None, "allow_backup": (flag(app, "allowBackup") is not False) if app else True, "application": get(app, "name") if app else None,
        "components": [],
    }
    clear = flag(app, "usesCleartextTraffic") if app else None
    out["cleartext"] = clear if clear is not None else out["effective_target"] < 28
    for k, c in enumerate(inner(app, *COMPONENTS) if app else ()):
        filters = []
        for f in inner(c, "intent-filter"):
            groups = [{"allow": flag(g, "allow") is not False, "data": [{"parts": [{"part": p, "kind": kind, "value": get(d, key)} for key, (p, kind) in GROUP_PARTS.items() if get(d, key) is not None]} for d in inner(g, "data")]} for g in inner(f, "uri-relative-filter-group")]
            filters.append({"actions": [get(x, "name") for x in inner(f, "action")], "categories": [get(x, "name") for x in inner(f, "category")], "data": [{v: get(d, key) for key, v in DATA_KEYS.items()} for d in inner(f, "data")], "groups": groups})
        exported, kind = flag(c, "exported"), COMPONENTS[c["name"]]
        if exported is not None:
            effective, state = exported, "explicit"
        elif kind == "provider":
            effective, state = out["effective_target"] < 17, "legacy_inferred"
        else:
            effective, state = bool(filters), "missing_required" if filters and out["effective_target"] >= 31 else "legacy_inferred"
        out["components"].append({"kind": kind, "ord": k, "name": get(c, "name"), "exported": exported, "effective_exported": effective, "exported_state": state, "permission": get(c, "permission"), "process": get(c, "process"), "authorities": get(c, "authorities"), "target": get(c, "targetActivity"), "filters": filters})
    return out
