"""The catalogue of tools: names, categories, support, anchors."""

from __future__ import annotations

import re
from dataclasses import dataclass

FULL, PARTIAL, EXTERNAL, DOCUMENTATION, PASS = "full", "partial", "external_execution", "documentation_only", "pass_through"

# Category | tool | support | inputs | outputs | b for blocking | other names
_CATALOGUE = """
In/Out | Input Data | full | | Output | | dbfileinput
In/Out | Output Data | full | Input | | | dbfileoutput
In/Out | Browse | pass_through | Input | | | browsev2
In/Out | Text Input | full | | Output | |
In/Out | Directory | partial | | Output | |
In/Out | Date Time Now | full | | Output | |
Preparation | Auto Field | full | Input | Output | b |
Preparation | Data Cleanse Pro | partial | Input | Output | |
Preparation | Data Cleansing | full | Input | Output | | cleanse
Preparation | Filter | full | Input | True,False | |
Preparation | Formula | full | Input | Output | |
Preparation | Generate Rows | full | Input | Output | |
Preparation | Multi-Field Formula | full | Input | Output | |
Preparation | Multi-Row Formula | full | Input | Output | |
Preparation | Record ID | full | Input | Output | |
Preparation | Sample | full | Input | Output | |
Preparation | Select | full | Input | Output | |
Preparation | Select Records | full | Input | Output | |
Preparation | Sort | full | Input | Output | b |
Preparation | Tile | partial | Input | Output | b |
Preparation | Unique | full | Input | Unique,Duplicates | |
Preparation | Rank | full | Input | Output | b |
Preparation | Random % Sample | full | Input | Output | | randomsamplesize
Preparation | Create Samples | full | Input | Estimation,Validation,Holdout | |
Preparation | Multi-Field Binning | partial | Input | Output | b |
Join | Append Fields | full | Targets,Source | Output | |
Join | Find Replace | full | Targets,Source | Output | |
Join | Fuzzy Match | partial | Input | Output,Members | b |
Join | Join | full | Left,Right | Left,Join,Right | |
Join | Join Multiple | full | Input | Output | |
Join | Make Group | partial | Input | Output | b |
Join | Union | full | Input | Output | |
Parse | DateTime | full | Input | Output | |
Parse | RegEx | full | Input | Output | |
Parse | Text To Columns | full | Input | Output | |
Parse | XML Parse | partial | Input | Output | |
Transform | Arrange | full | Input | Output | |
Transform | Count Records | full | Input | Output | b |
Transform | Cross Tab | full | Input | Output | b |
Transform | Make Columns | full | Input | Output | b |
Transform | Running Total | full | Input | Output | |
Transform | Summarize | full | Input | Output | b |
Transform | Transpose | full | Input | Output | |
Developer | Block Until Done | pass_through | Input | Output1,Output2,Output3 | b |
Developer | Detour | partial | Input | Left,Right | |
Developer | Detour End | pass_through | Left,Right | Output | |
Developer | Download | external_execution | Input | Output | |
Developer | Dynamic Input | partial | Input | Output | |
Developer | Dynamic Rename | full | Input | Output | |
Developer | Dynamic Replace | partial | Targets,Expressions | Output,Errors | |
Developer | Dynamic Select | full | Input | Output | |
Developer | Field Info | full | Input | Output | |
Developer | JSON Build | full | Input | Output | b |
Developer | JSON Parse | full | Input | Output | |
Developer | Message | pass_through | Input | Output | |
Developer | Python | external_execution | 1,2,3 | 1,2,3 | | jupytercode
Developer | R | external_execution | 1,2,3 | 1,2,3 | |
Developer | Run Command | external_execution | Input | Output | b |
Documentation | Comment | documentation_only | | | | textbox
Documentation | Tool Container | documentation_only | | | |
Reporting | Email | external_execution | Input | | |
Reporting | Layout | documentation_only | Input | Output | |
Reporting | Render | documentation_only | Input | | b |
Reporting | Report Footer | documentation_only | Input | Output | |
Reporting | Report Header | documentation_only | Input | Output | |
Reporting | Report Map | documentation_only | Input | Output | |
Reporting | Report Text | documentation_only | Input | Output | |
Reporting | Table | documentation_only | Input | Output | |
Reporting | Interactive Chart | documentation_only | Input | Output | |
Reporting | Image | documentation_only | Input | Output | |
Spatial | Buffer | partial | Input | Output | |
Spatial | Create Points | partial | Input | Output | |
Spatial | Distance | partial | Input | Output | |
Spatial | Find Nearest | partial | Targets,Universe | Matched,Unmatched | b |
Spatial | Generalize | partial | Input | Output | |
Spatial | Heat Map | partial | Input | Output | b |
Spatial | Make Grid | partial | Input | Output | |
Spatial | Poly-Build | partial | Input | Output | b |
Spatial | Poly-Split | partial | Input | Output | |
Spatial | Smooth | partial | Input | Output | |
Spatial | Spatial Info | partial | Input | Output | |
Spatial | Spatial Match | partial | Targets,Universe | Matched,Unmatched | b |
Spatial | Spatial Process | partial | Input | Output | |
Spatial | Trade Area | partial | Input | Output | |
In-Database | Connect In-DB | external_execution | | Output | | lockininput
In-Database | Data Stream In | external_execution | Input | Output | b | lockinstreamin
In-Database | Data Stream Out | external_execution | Input | Output | | lockinstreamout
In-Database | Filter In-DB | external_execution | Input | True,False | | lockinfilter
In-Database | Formula In-DB | external_execution | Input | Output | | lockinformula
In-Database | Join In-DB | external_execution | Left,Right | Left,Join,Right | | lockinjoin
In-Database | Select In-DB | external_execution | Input | Output | | lockinselect
Connectors | Amazon S3 Download | external_execution | | Output | |
Connectors | Amazon S3 Upload | external_execution | Input | | |
Connectors | SharePoint Files Input | external_execution | | Output | |
Connectors | SharePoint Files Output | external_execution | Input | | |
Connectors | Salesforce Input | external_execution | | Output | |
Connectors | Salesforce Output (New) | external_execution | Input | | | salesforceoutput
Connectors | Tableau Output | external_execution | Input | | | publishtotableauserver
Connectors | MongoDB Input | external_execution | | Output | | mongoinput
Connectors | MongoDB Output | external_execution | Input | | | mongooutput
"""


@dataclass(frozen=True)
class ToolDefinition:
    category: str
    name: str
    support: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    blocking: bool
    aliases: tuple[str, ...]


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _read() -> tuple[ToolDefinition, ...]:
    out = []
    for line in _CATALOGUE.strip().splitlines():
        category, name, support, inputs, outputs, blocking, others = (x.strip() for x in line.split("|"))
        split = lambda s: tuple(x for x in s.split(",") if x)
        out.append(ToolDefinition(category, name, support, split(inputs), split(outputs), blocking == "b", tuple(dict.fromkeys([plain(name), *split(others)]))))
    return tuple(out)


TOOLS = _read()
_BY_ALIAS = {a: t for t in TOOLS for a in t.aliases}
#: Tools of all plugins whose names start alike, the longest start first.
_BY_PREFIX: dict[str, ToolDefinition] = {}
UNKNOWN = ToolDefinition("Unknown", "Unknown", "unsupported", ("Input",), ("Output",), False, ())


def type_of(plugin: str) -> str:
    """The last part of a dotted plugin name, the whole name if that part is a number; macro files by their name."""
    plugin = re.sub(r"\.yxmc$", "", plugin.replace("\\", "/").rsplit("/", 1)[-1], flags=re.I)
    last = plugin.rsplit(".", 1)[-1]
    return plugin if last.isdigit() else last


def lookup(plugin: str) -> ToolDefinition:
    """The tool of a plugin name, by any of its names; a maker's name that the type shares with its name space is left off."""
    kind = type_of(plugin)
    maker = re.match(r"[A-Z][a-z]+", plugin)
    tries = [kind, plugin]
    if maker and kind.startswith(maker.group()) and "." in plugin:
        tries.append(kind[len(maker.group()) :])
    for t in tries:
        if plain(t) in _BY_ALIAS:
            return _BY_ALIAS[plain(t)]
    for start in sorted(_BY_PREFIX, key=len, reverse=True):
        if plugin.lower().startswith(start):
            return _BY_PREFIX[start]
    return UNKNOWN


def add(tool: ToolDefinition, prefix: str | None = None) -> None:
    """Make a tool known, before others of the same names; with a prefix for all plugins too that no name is known of."""
    _BY_ALIAS.update(dict.fromkeys(tool.aliases, tool))
    if prefix:
        _BY_PREFIX[prefix.lower()] = tool
