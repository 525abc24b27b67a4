"""Refusals before data leaves: columns by allow-list, finite numbers, unambiguous names."""

import json

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, _parse_datatype_json_string


def _names(data_type: DataType, prefix: str = ""):
    """All column and field paths, nested ones included."""
    if isinstance(data_type, StructType):
        for field in data_type.fields:
            path = f"{prefix}{field.name}"
            yield path
            yield from _names(field.dataType, path + ".")
    elif isinstance(data_type, ArrayType):
        yield from _names(data_type.elementType, prefix)
    elif isinstance(data_type, MapType):
        yield from _names(data_type.keyType, prefix)
        yield from _names(data_type.valueType, prefix)


def select_allowed(df: DataFrame, allow: list[str], forbidden: list[str] = ()) -> DataFrame:
    """Only allowed columns. Refuses when a selected column, a field inside it, or anything it derives from is forbidden.

    Columns of files that were written with their lineage (``with_lineage``: staged tables, published tables, appended
    actions) are followed through to what they came from before they were written. Files of other writers start anew.
    """
    missing = [c for c in allow if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    chosen = df.select(*allow)
    barred = {f.lower() for f in forbidden}
    if barred:
        hits = sorted(c for c, names in origins(chosen).items() if barred & names)
        if hits:
            raise ValueError(f"forbidden columns in the selection: {hits}")
    return chosen


def origins(df: DataFrame) -> dict[str, set[str]]:
    """For each column, in lower case, all names that its value derives from: its own, aliases on the way, sources, fields.

    Read from the analysed plan's nodes and attribute ids, handed over once in Spark's own serialised form. An attribute
    that a node makes in a way not known here derives from all that the node reads.
    """
    plan = df._jdf.queryExecution().analyzed()
    nodes = json.loads(plan.toJSON())
    found = _Lineage(_stored(plan, nodes))
    output = found.plan(nodes)
    out: dict[str, set[str]] = {}
    for field, attribute in zip(df.schema.fields, output, strict=True):
        own = {n.lower() for path in _names(StructType([field])) for n in path.split(".")}
        out.setdefault(field.name, set()).update(own | found.names_of(attribute))
    return out


#: field metadata that names what a column derives from; Parquet files keep it next to the column
LINEAGE = "steadyline.origins"


def with_lineage(df: DataFrame) -> DataFrame:
    """``df``, each column with its origins as field metadata, so that they outlive a file. Data and plan stay the same.

    What a filter, a join condition or a grouping key lets through is not an origin of the columns beside it.
    """
    found = origins(df)
    return df.withColumns({c: F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, LINEAGE: sorted(found[c])}) for c in df.columns})


def lineage(df: DataFrame) -> DataFrame:
    """(column, origins): the lineage of a table's columns as rows."""
    rows = [(c, sorted(names)) for c, names in origins(df).items()]
    return df.sparkSession.createDataFrame(rows, "column string, origins array<string>")


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _stored(plan, nodes: list[dict]) -> dict[int, list[str]]:
    """Origins that metadata of the plan's sources names, by attribute id; sources inside its queries are read too."""
    out = {}
    inner = _items(plan.subqueriesAll())
    for part, own in [(plan, nodes), *[(q, json.loads(q.toJSON())) for q in inner]]:
        for leaf in _items(part.collectLeaves()):
            schema = leaf.schema().json()
            if LINEAGE in schema:
                fields = json.loads(schema)["fields"]
                ids = [a.exprId().id() for a in _items(leaf.output())]
                out.update({i: f["metadata"][LINEAGE] for i, f in zip(ids, fields, strict=True) if LINEAGE in f["metadata"]})
        # a column that is given metadata on the way; rare, so nodes are only walked where the serialised form shows one
        if any(_kind(n) == "Project" and "explicitMetadata" in e for n in own for tree in _trees(n.get("projectList")) for e in tree):
            out.update(_given(part))
    return out


def _given(node) -> dict[int, list[str]]:
    out = {}
    if node.getClass().getSimpleName() == "Project":
        for e in _items(node.projectList()):
            if e.getClass().getSimpleName() == "Alias" and e.explicitMetadata().isDefined():
                out[e.exprId().id()] = json.loads(e.explicitMetadata().get().json()).get(LINEAGE, [])
    for child in _items(node.children()):
        out.update(_given(child))
    return out


_CATALYST = "org.apache.spark.sql.catalyst"


def _kind(node) -> str:
    return node["class"].rsplit(".", 1)[-1]


def _trees(value):
    """The expressions below a node's field: each a list of nodes in preorder."""
    if isinstance(value, list) and value:
        if isinstance(value[0], dict) and "class" in value[0]:
            yield value
        else:
            for item in value:
                yield from _trees(item)


class _Lineage:
    """What each attribute is named and which attributes it derives from, by the ids of attributes."""

    def __init__(self, stored: dict[int, list[str]]):
        self.stored = stored
        self.names: dict[int, set[str]] = {}
        self.parents: dict[int, set[int]] = {}
        self.shared: dict[int, list[int]] = {}  # output of each common table expression

    def names_of(self, attribute: int) -> set[str]:
        seen, todo, names = {attribute}, [attribute], set()
        while todo:
            at = todo.pop()
            names |= self.names.get(at, set())
            new = self.parents.get(at, set()) - seen
            seen |= new
            todo += new
        return names

    def _add(self, attribute: int, names=(), parents=()):
        self.names.setdefault(attribute, set()).update(n.lower() for n in names)
        self.parents.setdefault(attribute, set()).update(set(parents) - {attribute})

    def plan(self, nodes: list[dict]) -> list[int]:
        """Read a plan, nodes in preorder; gives the ids of its output."""
        output, end = self._node(nodes, 0)
        if end != len(nodes):
            raise ValueError("a plan that is not one tree")
        return output

    def _node(self, nodes: list[dict], i: int) -> tuple[list[int], int]:
        node, children, at = nodes[i], [], i + 1
        for _ in range(node["num-children"]):
            output, at = self._node(nodes, at)
            children.append(output)
        read = [a for output in children for a in output]
        fields = {k: list(_trees(v)) for k, v in node.items() if k != "class"}
        for trees in fields.values():
            for tree in trees:
                self._expression(tree)
        kind, made = _kind(node), {k: [self._top(t) for t in trees] for k, trees in fields.items()}
        output = self._output(kind, node, made, children, read)
        if kind in ("Union", "Intersect", "Except"):
            if len({len(c) for c in children}) == 1:  # by place
                for place, attribute in enumerate(output):
                    self._add(attribute, (), [c[place] for c in children])
            else:
                for attribute in output:
                    self._add(attribute, (), read)
        if kind == "CTERelationDef":
            self.shared[node["id"]] = output
        if kind == "CTERelationRef":
            for attribute, source in zip(output, self.shared.get(node["cteId"], [])):
                self._add(attribute, (), [source])
        if kind == "Generate":
            sources = [e for tree in fields.get("generator", []) for e in self._expression(tree)]
            for attribute in made["generatorOutput"]:
                self._add(attribute, (), sources)
        elif children:
            # neither read nor defined by an alias: in a way not known here
            for attribute in set(output) - set(read) - self._aliases(fields):
                self._add(attribute, (), read)
        return output, at

    def _output(self, kind, node, made, children, read) -> list[int]:
        if kind in ("Project", "Aggregate"):
            return made["projectList" if kind == "Project" else "aggregateExpressions"]
        if kind == "Window":
            return read + made["windowExpressions"]
        if kind == "Generate":
            return [a for i, a in enumerate(read) if i not in (node.get("unrequiredChildIndex") or [])] + made["generatorOutput"]
        if "output" in made and (made["output"] or not children):
            return made["output"]
        if kind in ("Union", "Intersect", "Except"):
            return children[0]
        if kind == "WithCTE":
            return children[-1]
        if kind in ("Join", "LateralJoin", "AsOfJoin"):
            how = json.dumps(node.get("joinType", ""))
            return children[0] if "LeftSemi" in how or "LeftAnti" in how else read + [a for ids in made.values() for a in ids if "ExistenceJoin" in how and a not in read]
        return read

    @staticmethod
    def _top(tree) -> int:
        """Id of a named expression; -1 of one that has none."""
        return (tree[0].get("exprId") or {}).get("id", -1) if isinstance(tree[0].get("exprId"), dict) else -1

    def _aliases(self, fields) -> set[int]:
        return {e["exprId"]["id"] for trees in fields.values() for tree in trees for e in tree if _kind(e) == "Alias"}

    def _expression(self, tree: list[dict]) -> set[int]:
        """Read an expression, defining its aliases; gives the attributes that it reads."""
        return self._subtree(tree, 0)[1]

    def _subtree(self, tree: list[dict], i: int) -> tuple[int, set[int], set[str]]:
        node, kind = tree[i], _kind(tree[i])
        reads, names = set(), set()
        if kind == "AttributeReference":
            at = node["exprId"]["id"]
            reads.add(at)
            if at not in self.names:
                nested = [part for path in _names(_parse_datatype_json_string(json.dumps(node["dataType"]))) for part in path.split(".")]
                self._add(at, [node["name"], *nested, *self.stored.get(at, [])])
        elif kind == "GetStructField" and node.get("name"):
            names.add(node["name"])
        elif kind == "GetArrayStructFields":
            names.add(node["field"]["name"])
        for key, value in node.items():
            for inner in _trees(value) if isinstance(value, list) else ():
                # a query inside an expression, or an expression that is no child, such as an outer reference
                reads |= set(self.plan(inner)) if inner[0]["class"].startswith(f"{_CATALYST}.plans") or key == "plan" else self._expression(inner)
        at = i + 1
        for _ in range(node["num-children"]):
            at, inner_reads, inner_names = self._subtree(tree, at)
            reads |= inner_reads
            names |= inner_names
        if kind == "Alias":
            at_alias = node["exprId"]["id"]
            self._add(at_alias, [node["name"], *names, *self.stored.get(at_alias, [])], reads)
        return at, reads, names


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]


def nonfinite_counts(df: DataFrame) -> DataFrame:
    """Per float column, how many values are NaN or infinite; one pass."""
    columns = float_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, nonfinite bigint")
    infinity = float("inf")
    counts = df.agg(
        *[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == infinity)).alias(c) for c in columns]
    )
    return counts.unpivot([], columns, "column", "nonfinite")


def assert_finite(df: DataFrame) -> DataFrame:
    bad = nonfinite_counts(df).filter("nonfinite > 0").collect()  # one row per column at most
    if bad:
        raise ValueError("non-finite values: " + ", ".join(f"{r['column']}={r['nonfinite']}" for r in bad))
    return df


def ambiguous_columns(df: DataFrame) -> list[str]:
    """Names that occur twice (ignoring case), or that carry a join suffix next to their plain form."""
    lowered = [c.lower() for c in df.columns]
    twice = {c for c in lowered if lowered.count(c) > 1}
    suffixed = {c for c in lowered for s in ("_x", "_y", "_left", "_right") if c.endswith(s) and c[: -len(s)] in lowered}
    pairs = {c for c in lowered if c.endswith("_x") and c[:-2] + "_y" in lowered}
    return sorted(twice | suffixed | pairs)


def assert_unambiguous(df: DataFrame) -> DataFrame:
    names = ambiguous_columns(df)
    if names:
        raise ValueError(f"ambiguous columns: {names}")
    return df
