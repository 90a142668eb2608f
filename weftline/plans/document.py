"""Workflow documents: bytes to a workflow.

A document is XML (``.yxmd``, ``.xml``) or a ZIP package that holds one (``.yxwz``). Disabled nodes and the
contents of disabled containers are left out; secrets are blotted out of everything that is kept.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from weftline.plans import registry

MAX_ENTRIES, MAX_BYTES = 100, 100 * 1024 * 1024
REDACTED = "[REDACTED]"

# Names of members that hold secrets.
_SECRET = r"password|pwd|secret|token|api_?key|client_?secret|access_?token|credential|private_?key|auth_?token"
_SECRET_NAME = re.compile(_SECRET, re.I)
_ENDS = frozenset("; ,&\t\r\n\"'<>")


class DocumentError(ValueError):
    """The bytes are no workflow document."""


def without_secrets(text: str) -> str:
    """Values behind ``=`` blotted out where the name before it is one of a secret, as in connection strings."""
    parts = text.split("=")
    for i in range(1, len(parts)):
        before, value = parts[i - 1].rstrip(), parts[i].lstrip()
        name = before[max((k + 1 for k, ch in enumerate(before) if ch in _ENDS), default=0) :]
        if value[:1] in ("'", '"'):  # up to the other quote
            end = value.find(value[0], 1) + 1 or len(value)
        else:
            end = next((k for k, ch in enumerate(value) if ch in _ENDS), len(value))
        if end and _SECRET_NAME.search(name):
            parts[i] = REDACTED + value[end:]
    return "=".join(parts)


class Config:
    """The Configuration element of a tool, secrets blotted out."""

    def __init__(self, element: ET.Element | None) -> None:
        self.element = _redacted(element) if element is not None else ET.Element("Configuration")

    def text(self, *tags: str, default: str | None = None) -> str | None:
        """Text, or else attribute ``value``, of the first of the elements, whatever the case of its name; attributes count too."""
        for tag in tags:
            for e in self.element.iter():
                if e.tag.lower() == tag.lower():
                    found = (e.text or "").strip() or e.get("value") or e.get(tag.lower()) or e.get("field")
                    if found:
                        return found
            for k, v in self.element.attrib.items():
                if k.lower() == tag.lower() and v:
                    return v
        return default

    def raw(self, tag: str) -> str | None:
        e = self.element.find(f".//{tag}")
        return e.text if e is not None else None

    def flag(self, tag: str, default: bool = False) -> bool:
        value = self.text(tag)
        return default if value is None else value.strip().lower() in ("true", "1", "yes")

    def number(self, *tags: str, default: float | None = None) -> float | None:
        try:
            return float(self.text(*tags) or "")
        except ValueError:
            return default

    def each(self, path: str) -> list[dict[str, str]]:
        return [dict(e.attrib) for e in self.element.findall(f".//{path}")]

    def names(self, path: str, key: str = "field") -> list[str]:
        return [x[k] for x in self.each(path) for k in (key, "name") if x.get(k)][: len(self.each(path))]

    def xml(self) -> str:
        return ET.tostring(self.element, encoding="unicode")

    def parsed(self) -> dict:
        return _as_dict(self.element)


def _redacted(element: ET.Element, hidden: bool = False) -> ET.Element:
    hidden = hidden or bool(_SECRET_NAME.search(element.tag))
    out = ET.Element(element.tag, {k: REDACTED if _SECRET_NAME.search(k) else without_secrets(v) for k, v in element.attrib.items()})
    text = element.text or ""
    out.text = (REDACTED if text.strip() else text) if hidden else without_secrets(text)
    out.tail = element.tail
    out.extend(_redacted(e, hidden) for e in element)
    return out


def _as_dict(element: ET.Element) -> dict:
    """Attributes and children by name; repeated names make lists; text of a leaf under ``value``."""
    out: dict = dict(element.attrib)
    for child in element:
        made = _as_dict(child)
        made = made["value"] if set(made) == {"value"} and not child.attrib else made
        if child.tag in out:
            out[child.tag] = [*out[child.tag], made] if isinstance(out[child.tag], list) else [out[child.tag], made]
        else:
            out[child.tag] = made
    if not len(element) and (element.text or "").strip():
        out["value"] = element.text.strip()
    return out


@dataclass(frozen=True)
class DocumentField:
    name: str
    type: str
    size: int | None = None
    scale: int | None = None


@dataclass(frozen=True)
class Tool:
    tool_id: int
    plugin: str
    definition: registry.ToolDefinition
    config: Config
    name: str = ""
    annotation: str = ""
    fields: tuple[DocumentField, ...] = ()
    engine: tuple[tuple[str, str], ...] = ()
    container_id: int | None = None
    position: tuple[int, int] | None = None


@dataclass(frozen=True)
class Connection:
    origin: int
    origin_anchor: str
    destination: int
    destination_anchor: str


@dataclass
class Container:
    tool_id: int
    caption: str
    disabled: bool
    folded: bool
    parent_id: int | None
    children: list[int] = field(default_factory=list)


@dataclass
class Workflow:
    name: str
    version: str = ""
    author: str | None = None
    description: str | None = None
    properties: dict = field(default_factory=dict)
    tools: dict[int, Tool] = field(default_factory=dict)
    connections: list[Connection] = field(default_factory=list)
    containers: dict[int, Container] = field(default_factory=dict)
    text_boxes: dict[int, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        """The workflow for JSON, secrets blotted out."""
        return {
            "metadata": {"name": self.name, "version": self.version, "author": self.author, "description": self.description, "properties": self.properties},
            "tools": [{"tool_id": t.tool_id, "plugin": t.plugin, "tool": t.definition.name, "support": t.definition.support, "name": t.name, "annotation": t.annotation, "container_id": t.container_id, "configuration": t.config.parsed(), "fields": [vars(f) for f in t.fields]} for t in self.tools.values()],
            "connections": [vars(c) for c in self.connections],
            "containers": [vars(c) for c in self.containers.values()],
            "text_boxes": self.text_boxes,
        }


def unpack(data: bytes) -> bytes:
    """The XML of a document: itself, or the first workflow of a package. Packages of too many or too large entries, or with
    names that lead out of it, are refused."""
    if not data.startswith(b"PK\x03\x04"):
        if not data.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<"):
            raise DocumentError("neither XML nor a package")
        return data
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise DocumentError("the package is damaged") from e
    entries = package.infolist()
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
        raise DocumentError("the package is too large")
    for e in entries:
        path = PurePosixPath(e.filename.replace("\\", "/"))
        if path.is_absolute() or ".." in path.parts or re.match(r"[A-Za-z]:", e.filename):
            raise DocumentError(f"the package has an unsafe name: {e.filename}")
    inner = next((e for e in entries if e.filename.lower().endswith(".yxmd")), None)
    if inner is None:
        raise DocumentError("the package holds no workflow")
    return package.read(inner)


def load(source: str | Path | bytes, name: str = "workflow") -> Workflow:
    """A document from a path or from bytes."""
    if not isinstance(source, bytes):
        name, source = Path(source).stem, Path(source).read_bytes()
    xml = unpack(source)
    if b"<!ENTITY" in xml:
        raise DocumentError("entities are not allowed")
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise DocumentError(f"not well-formed: {e}") from e
    meta = lambda tag: (root.findtext(f"./Properties/MetaInfo/{tag}") or "").strip() or None
    properties = root.find("Properties")
    flow = Workflow(meta("Name") or name, root.get("yxmdVer", ""), meta("Author"), meta("Description"), _as_dict(_redacted(properties)) if properties is not None else {})
    top = root.find("Nodes")
    for node in (top if top is not None else root).findall("Node"):
        _read_node(node, None, flow)
    for c in root.findall(".//Connections/Connection"):
        a, b = c.find("Origin"), c.find("Destination")
        if a is not None and b is not None:
            flow.connections.append(Connection(_int(a.get("ToolID")), a.get("Connection", ""), _int(b.get("ToolID")), b.get("Connection", "")))
    return flow


def _int(text: str | None, default: int | None = 0) -> int | None:
    try:
        return int(text or "")
    except ValueError:
        return default


def _children(node: ET.Element) -> list[ET.Element]:
    return [n for holder in node.findall("ChildNodes") + node.findall("Properties/ChildNodes") for n in holder.findall("Node")]


def _switched_on(parent: ET.Element | None, tag: str) -> bool:
    e = parent.find(tag) if parent is not None else None
    return e is not None and e.get("value", "False") == "True"


def _read_node(node: ET.Element, within: Container | None, flow: Workflow) -> None:
    tool_id = _int(node.get("ToolID"))
    gui = node.find("GuiSettings")
    plugin = gui.get("Plugin", "") if gui is not None else ""
    properties = node.find("Properties")
    config = properties.find("Configuration") if properties is not None else None
    if "ToolContainer" in plugin:
        caption = (config.findtext("Caption") or "").strip() if config is not None else ""
        box = Container(tool_id, caption or f"Container #{tool_id}", _switched_on(config, "Disabled") or bool(within and within.disabled), _switched_on(config, "Folded"), within.tool_id if within else None)
        flow.containers[tool_id] = box
        for child in _children(node):
            _read_node(child, box, flow)
        return
    if "TextBox" in plugin:
        flow.text_boxes[tool_id] = (config.findtext("Text") or "").strip() if config is not None else ""
        return
    if "Questions" in plugin:
        return
    if not (_switched_on(properties, "Disabled") or within and within.disabled):
        place = gui.find("Position") if gui is not None else None
        x, y = (_int(place.get(k), None) for k in "xy") if place is not None else (None, None)
        fields = tuple(DocumentField(f.get("name", ""), f.get("type", ""), _int(f.get("size"), None), _int(f.get("scale"), None)) for f in node.findall("./Properties/MetaInfo/RecordInfo/Field"))
        engine = node.find("EngineSettings")
        flow.tools[tool_id] = Tool(
            tool_id, plugin, registry.lookup(plugin), Config(config), node.findtext("./Properties/Annotation/Name") or "", node.findtext("./Properties/Annotation/DefaultAnnotationText") or "",
            fields, tuple(engine.attrib.items()) if engine is not None else (), within.tool_id if within else None, (x, y) if x is not None and y is not None else None,
        )
        if within:
            within.children.append(tool_id)
    for child in _children(node):
        _read_node(child, within, flow)
