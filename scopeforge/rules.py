"""Rule tables: the extension points of the engine, shipped as small DataFrames.

Everything here is data.  The search joins ``type_rules``; extraction joins
``emit_rules``, ``walk_rules`` and ``macro_rules``.  All tables are tiny and of
fixed size, so they are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the indexed language server's behaviour).
# Type compatibility.  USAGE_TYPES: type of the symbol under the cursor when it
# is a usage -> node types a matching symbol may have.  ASSIGNMENT_TYPES: the
# same for a symbol that is an assignment.  Definition search uses the first map
# only, reference search both (a type found in both counts twice).
USAGE_TYPES = {
    "Alias": ["Alias", "Def", "Defs", "CSend", "Send", "Super", "ZSuper"],
    "Const": ["Casgn", "Class", "Module", "Const"],
    "CSend": ["Alias", "Def", "Defs", "CSend", "Send", "Super", "ZSuper"],
    "Cvar": ["Cvasgn", "Cvar"],
    "Gvar": ["Gvasgn", "Gvar"],
    "Ivar": ["Ivasgn", "Ivar"],
    "Lvar": ["Arg", "Kwarg", "Kwoptarg", "Kwrestarg", "Lvasgn", "MatchVar", "Optarg",
             "Restarg", "Shadowarg", "Lvar"],
    "Send": ["Alias", "Def", "Defs", "CSend", "Send", "Super", "ZSuper"],
    "Super": ["Alias", "Def", "Defs", "CSend", "Send", "Super", "ZSuper"],
    "ZSuper": ["Alias", "Def", "Defs", "CSend", "Send", "Super", "ZSuper"],
}
_LOCAL = ["Arg", "Kwarg", "Kwoptarg", "Kwrestarg", "Lvasgn", "MatchVar", "Optarg",
          "Restarg", "Shadowarg"]
ASSIGNMENT_TYPES = {
    "Alias": ["Alias", "CSend", "Send", "Super", "ZSuper", "Def", "Defs"],
    "Arg": ["Lvar"] + _LOCAL,
    "Casgn": ["Const", "Casgn", "Class", "Module"],
    "Class": ["Const", "Casgn", "Class", "Module"],
    "Cvasgn": ["Cvar", "Cvasgn"],
    "Def": ["Alias", "CSend", "Send", "Super", "ZSuper", "Def"],
    "Defs": ["Alias", "CSend", "Send", "Super", "ZSuper", "Defs"],
    "Gvasgn": ["Gvar", "Gvasgn"],
    "Ivasgn": ["Ivar", "Ivasgn"],
    "Kwarg": ["Lvar"] + _LOCAL,
    "Kwoptarg": ["Lvar"] + _LOCAL,
    "Kwrestarg": ["Lvar"] + _LOCAL,
    "Lvasgn": ["Lvar"] + _LOCAL,
    "MatchVar": ["Lvar"] + _LOCAL,
    "Module": ["Const", "Casgn", "Class", "Module"],
    "Optarg": ["Lvar"] + _LOCAL,
    "Restarg": ["Lvar"] + _LOCAL,
    "Shadowarg": ["Lvar"] + _LOCAL,
}
# Usage types whose scope names are all required (local variables).
LOCAL_SCOPE_TYPES = _LOCAL + ["Lvar"]
# Types listed by workspace symbol search.
WORKSPACE_SYMBOL_TYPES = ["Alias", "Casgn", "Class", "Def", "Defs", "Gvasgn", "Module"]
# Result sizes: point lookup 1, definitions 50, references 100, workspace symbols 100.
LOOKUP_LIMIT = 1
DEFINITION_LIMIT = 50
REFERENCE_LIMIT = 100
WORKSPACE_LIMIT = 100
# Boost of receiver (class) scope names in method definition search.
RECEIVER_SCOPE_BOOST = 10000.0
# Okapi BM25 parameters of the scoring library.
BM25_K1 = 1.2
BM25_B = 0.75

# Emission rules: node kind -> row.  (kind, slot, category, node_type, span).  The two
# sides of an alias are its symbol children in slots "to" and "from"; every other rule
# is for the node itself, in any slot ("*").  Span: the whole expression, or the name
# (selector, keyword); classes and modules have the span of their qualified name.
EMIT_RULES = [
    ("Alias", "to", "assignment", "Alias", "expr"),
    ("Alias", "from", "usage", "Alias", "expr"),
    ("Arg", "*", "assignment", "Arg", "expr"),
    ("Casgn", "*", "assignment", "Casgn", "name"),
    ("Class", "*", "assignment", "Class", "name"),
    ("Const", "*", "usage", "Const", "name"),
    ("CSend", "*", "usage", "CSend", "name"),
    ("Cvar", "*", "usage", "Cvar", "expr"),
    ("Cvasgn", "*", "assignment", "Cvasgn", "name"),
    ("Def", "*", "assignment", "Def", "name"),
    ("Defs", "*", "assignment", "Defs", "name"),
    ("Gvar", "*", "usage", "Gvar", "expr"),
    ("Gvasgn", "*", "assignment", "Gvasgn", "name"),
    ("Ivar", "*", "usage", "Ivar", "expr"),
    ("Ivasgn", "*", "assignment", "Ivasgn", "name"),
    ("Kwarg", "*", "assignment", "Kwarg", "name"),
    ("Kwoptarg", "*", "assignment", "Kwoptarg", "name"),
    ("Kwrestarg", "*", "assignment", "Kwrestarg", "name"),
    ("Lvar", "*", "usage", "Lvar", "expr"),
    ("Lvasgn", "*", "assignment", "Lvasgn", "name"),
    ("MatchVar", "*", "assignment", "MatchVar", "name"),
    ("Module", "*", "assignment", "Module", "name"),
    ("Optarg", "*", "assignment", "Optarg", "name"),
    ("Restarg", "*", "assignment", "Restarg", "name"),
    ("Send", "*", "usage", "Send", "name"),
    ("Shadowarg", "*", "assignment", "Shadowarg", "expr"),
    ("Super", "*", "usage", "Super", "name"),
    ("Sym", "*", "usage", "Send", "expr"),
    ("ZSuper", "*", "usage", "ZSuper", "expr"),
]

# Generated definitions of class-level macros: (method, argument policy,
# string arguments allowed, name suffix).  Policy "all" = every argument,
# "first" = the first argument only.  Generated rows are assignments of type Def.
MACRO_RULES = [
    ("attr_accessor", "all", False, ""),
    ("attr_accessor", "all", False, "="),
    ("attr_writer", "all", False, "="),
    ("attr_reader", "all", False, ""),
    ("alias_method", "first", True, ""),
    ("belongs_to", "first", False, ""),
    ("has_one", "first", False, ""),
    ("has_many", "first", False, ""),
    ("has_and_belongs_to_many", "first", False, ""),
]

# Walk rules: slots whose children are visited, per node kind.  Children in any
# other slot (and children of kinds not listed) emit nothing.
WALK_RULES = {
    # kinds that emit a row and then visit children
    "Casgn": ["scope", "value"], "Class": ["name", "superclass", "body"],
    "Const": ["scope"], "CSend": ["recv", "args"], "Cvasgn": ["value"],
    "Def": ["args", "body"], "Defs": ["args", "body"], "Gvasgn": ["value"],
    "Ivasgn": ["value"], "Kwoptarg": ["default"], "Lvasgn": ["value"],
    "Module": ["body"], "Optarg": ["default"], "Send": ["recv", "args"],
    "Super": ["args"],
    # kinds that only pass on to children
    "And": ["lhs", "rhs"], "AndAsgn": ["recv", "value"], "Args": ["args"],
    "Array": ["elements"], "ArrayPattern": ["elements"],
    "ArrayPatternWithTail": ["elements"], "Begin": ["statements"],
    "Block": ["call", "args", "body"], "BlockPass": ["value"], "Break": ["args"],
    "Case": ["expr", "when_bodies", "else_body"],
    "CaseMatch": ["expr", "in_bodies", "else_body"], "ConstPattern": ["const", "pattern"],
    "Defined": ["value"], "Dstr": ["parts"], "Dsym": ["parts"],
    "EFlipFlop": ["left", "right"], "Ensure": ["body", "ensure"],
    "Erange": ["left", "right"], "FindPattern": ["elements"],
    "For": ["iterator", "iteratee", "body"], "Hash": ["pairs"],
    "HashPattern": ["elements"], "Heredoc": ["parts"],
    "If": ["cond", "if_true", "if_false"], "IfGuard": ["cond"],
    "IFlipFlop": ["left", "right"], "IfMod": ["cond", "if_true", "if_false"],
    "IfTernary": ["cond", "if_true", "if_false"], "Index": ["recv", "indexes"],
    "IndexAsgn": ["recv", "indexes", "value"], "InPattern": ["pattern", "guard", "body"],
    "Irange": ["left", "right"], "Kwargs": ["pairs"], "KwBegin": ["statements"],
    "Kwsplat": ["value"], "Masgn": ["lhs", "rhs"], "MatchAlt": ["lhs", "rhs"],
    "MatchAs": ["value", "as"], "MatchCurrentLine": ["re"],
    "MatchPattern": ["value", "pattern"], "MatchPatternP": ["value", "pattern"],
    "MatchRest": ["name"], "MatchWithLvasgn": ["re", "value"], "Mlhs": ["items"],
    "Next": ["args"], "Numblock": ["call", "body"], "OpAsgn": ["recv", "value"],
    "Or": ["lhs", "rhs"], "OrAsgn": ["recv", "value"], "Pair": ["key", "value"],
    "Pin": ["var"], "Postexe": ["body"], "Preexe": ["body"], "Procarg0": ["args"],
    "Regexp": ["parts", "options"], "Rescue": ["body", "rescue_bodies"],
    "RescueBody": ["exc_list", "exc_var", "body"], "Return": ["args"],
    "SClass": ["expr", "body"], "Splat": ["value"], "Undef": ["names"],
    "UnlessGuard": ["cond"], "Until": ["cond", "body"], "UntilPost": ["cond", "body"],
    "When": ["patterns", "body"], "While": ["cond", "body"],
    "WhilePost": ["cond", "body"], "XHeredoc": ["parts"], "Xstr": ["parts"],
    "Yield": ["args"],
}
# Subtrees skipped for interface-only roots: the node itself and its subtree
# (argument lists, blocks) or only its children (method bodies).
INTERFACE_PRUNE_SELF = ["Args", "Block"]
INTERFACE_PRUNE_CHILDREN = ["Def", "Defs"]

# Symbol kinds of listed symbols and highlight kinds.
SYMBOL_KINDS = {"Alias": "METHOD", "Def": "METHOD", "Defs": "METHOD",
                "Casgn": "CLASS", "Class": "CLASS", "Module": "MODULE"}
SYMBOL_KIND_DEFAULT = "VARIABLE"
# END FIXED VALUES
# ---------------------------------------------------------------------------

NODE_TYPES = sorted({rule[3] for rule in EMIT_RULES})


def type_rules(spark: SparkSession) -> DataFrame:
    """(probe_type, match_type, direction, multiplicity) for both maps."""
    rows = [(p, m, "usage") for p, ms in USAGE_TYPES.items() for m in ms]
    rows += [(p, m, "assignment") for p, ms in ASSIGNMENT_TYPES.items() for m in ms]
    df = spark.createDataFrame(rows, "probe_type string, match_type string, direction string")
    return df.withColumn("multiplicity", F.lit(1))


def emit_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMIT_RULES, "kind string, slot string, category string, node_type string, span string")


def macro_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MACRO_RULES, "method string, arg_policy string, allow_str boolean, suffix string")


def walk_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, s) for k, slots in WALK_RULES.items() for s in slots]
    return spark.createDataFrame(rows, "kind string, slot string")
