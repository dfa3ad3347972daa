"""Rules of weaknesses on lines of decompiled code, as data: what is visible, what an operation is worth, what controls it."""

from __future__ import annotations

# Patterns and points that results depend on. All patterns ignore case where they do not say otherwise.
COPY = r"\b(?:(?:_*(?:w?mem(?:cpy|move)|w?cs(?:cpy|ncpy|cat|ncat)|str(?:cpy|ncpy|cat|ncat))(?:_chk)?)|\w*printf|fread|recv|copy)\b"
ALLOCATES = r"(?:\b(?:malloc|calloc|realloc|strdup)\s*\(|\b(?:operator_new|new\b))"
RELEASES = r"(?:\bfree\s*\(|\b(?:operator_delete|delete\b))"
C_ALLOCATES, CPP_ALLOCATES = r"\b(?:malloc|calloc|realloc|strdup)\s*\(", r"\b(?:operator_new|new\b)"
C_RELEASES, CPP_RELEASES = r"\bfree\s*\(", r"\b(?:operator_delete|delete\b)"
OPERATION = r"(?:\b(?:memcpy|memmove|strcpy|strncpy|strcat|strncat|sprintf|snprintf|printf|fprintf|scanf|fscanf|malloc|calloc|realloc|free|new|delete)\b|(?:<<|>>|\+\+|--|\+=|-=|\*=)|(?:\[[^\]]+\]\s*=))"
DECLARATION = r"(?-i)^\s*(?:(?:const|volatile|signed|unsigned)\s+)*(?:void|char|short|int|long|float|double|size_t|u?int\d*_t|undefined\d*|[A-Za-z_]\w*(?:<[^;]+>)?)\s+[*&\s]*[A-Za-z_]\w*(?:\s*\[[^\]]*\])?\s*;\s*$"
NEGATIVE = r"(?:\+\s*-\s*(?:1|2|4|8)|-\s*(?:1|2|4|8)|0xffffffff)"
NUMBER = r"(?:0x[0-9a-f]+|\d+)"
LITERAL = r"\"[^\"\\]*(?:\\.[^\"\\]*)*\""
ELEMENT, VARIABLE_ELEMENT, CONSTANT_ELEMENT = r"\[[^\]]+\]", r"\[[^\]]*[a-z_][a-z0-9_]*[^\]]*\]", r"\[\s*(?:0x[0-9a-f]+|\d+)\s*\]"
MEMBER_OR_ELEMENT = r"(?:->|\[[^\]]+\]|\*\s*[A-Za-z_])"
IF, BRANCH = r"(?-i)^if \(", r"(?-i)^(?:if|for|while) \(|^do \{"
READS = r"(?:fscanf|scanf|recv|read|fgets|atoi|strto\w*)\s*\("
CASTS = r"(?:\((?:u?int|u?long|u?short|u?char|size_t)\)|SUB\d+|CONCAT\d+)"
_MEMORY_WORDS = r"(?:_*(?:w?mem|w?cs|str)(?:cpy|ncpy|cat|ncat)(?:_chk)?)"
_DATA_OR_RESULT = r"\b(?:data|result)\b"
_PRINTS = r"(?:print\w*line|\w*printf"

#: What a line must show to be an operation of a weakness at all.
TARGETS = {
    "CWE-23 CWE-36": r"(?:fopen|open|remove|rename|strcat|strncat|realpath|fgets|recv|read|getenv)",
    "CWE-78": r"(?:system|popen|exec\w*|winexec|createprocess|command|cmd)",
    "CWE-120": rf"(?:{_MEMORY_WORDS}|sprintf|snprintf|fread|recv|copy|\[[^\]]+\])",
    "CWE-121": rf"(?:{_MEMORY_WORDS}|w?memset|\w*printf|fread|recv|\[[^\]]+\])",
    "CWE-122": rf"(?:malloc|calloc|realloc|new|{_MEMORY_WORDS}|w?memset|\w*printf|fread|recv|\[[^\]]+\])",
    "CWE-124": rf"(?:{_MEMORY_WORDS}|sprintf|snprintf|\[[^\]]*(?:[A-Za-z_]\w*|-\s*1|0xffffffff)[^\]]*\]|\bdata\s*=\s*\w+\s*(?:\+\s*-\s*\d+|-\s*(?:1|2|4|8)))",
    "CWE-126": rf"(?:{_MEMORY_WORDS}|printf|print\w*line|fwrite|send|data(?:Bad|Good)Buffer|\[[^\]]+\])",
    "CWE-127": rf"(?:{_MEMORY_WORDS}|printf|print\w*line|\[[^\]]*(?:[A-Za-z_]\w*|-\s*1|0xffffffff)[^\]]*\])",
    "CWE-134": r"(?:\w*printf|syslog)",
    "CWE-190": r"(?:\+\s*[A-Za-z0-9_(]|[A-Za-z0-9_)]\s*\+|\*|<<)",
    "CWE-191": r"(?:-\s*[A-Za-z0-9_(]|[A-Za-z0-9_)]\s*-|--)",
    "CWE-194": r"(?:\((?:u?int|u?long|u?short|u?char|size_t)|malloc|calloc|\[[^\]]+\])",
    "CWE-195": r"(?:\((?:u?int|u?long|u?short|u?char|size_t)|memcpy|memmove|strncpy|malloc|calloc|\[[^\]]+\])",
    "CWE-197": r"(?:\((?:u?int|u?long|u?short|u?char)|SUB\d+|CONCAT\d+)",
    "CWE-369": r"(?:/|%|div\b)",
    "CWE-400": r"(?:while|for\s*\(|malloc|calloc|operator_new|new|sleep|socket|connect|accept)",
    "CWE-401": r"(?:malloc|calloc|realloc|strdup|operator_new|new\b)",
    "CWE-404": r"(?:fopen|open\s*\(|fdopen|fclose|close\s*\()",
    "CWE-427": r"(?:system|popen|execl|execv|loadlibrary|createprocess|getenv|PATH)",
    "CWE-457": r"(?:print\w*line|printf|memcpy|memmove|\*\s*[A-Za-z_]|[A-Za-z_]\w*\s*\[[^\]]+\])",
    "CWE-464": r"(?:memset|memcpy|strcpy|strncpy|\[[^\]]+\]\s*=)",
    "CWE-588": r"(?:printStructLine|->|\*\s*\([A-Za-z_].*\))",
    "CWE-590": r"(?:free|delete|operator_delete)",
    "CWE-606": r"(?:while|for\s*\(|do\s*\{|fgets|scanf|recv)",
    "CWE-617": r"(?:assert|abort|__assert_fail)",
    "CWE-665": r"(?:memcpy|memmove|strcpy|strncpy|print\w*line|printf)",
    "CWE-672": r"(?:free|delete|operator_delete|->|\*\s*[A-Za-z_])",
    "CWE-680": r"(?:malloc|calloc|realloc|operator_new|new|memset|memcpy|\*|<<)",
    "CWE-690": r"(?:malloc|calloc|realloc|operator_new|new|->|\*\s*[A-Za-z_])",
    "CWE-761": r"(?:free|delete|operator_delete|\+\+|--|\+=|-=)",
    "CWE-762": r"(?:malloc|calloc|realloc|operator_new|new|free|delete|operator_delete)",
    "CWE-773 CWE-775": r"(?:fopen|open\s*\(|fdopen|socket|fclose|close\s*\()",
    "CWE-789": r"(?:malloc|calloc|realloc|operator_new|new|alloca|rand|scanf|fgets)",
}
#: Weaknesses whose operations a memory copy is too.
COPYING = "CWE-120 CWE-121 CWE-122 CWE-124 CWE-126 CWE-127"

#: A relation is visible in a code if all patterns of one of its weakness' rules are; one after ! must not be.
VISIBLE = [
    ("CWE-23 CWE-36", r"(?:fopen|open\s*\(|remove\s*\(|rename\s*\(|realpath)"),
    ("CWE-78", r"(?:system|popen|exec\w*|winexec|createprocess)\s*\("),
    ("CWE-120", COPY),
    ("CWE-121", COPY, r"(?:char|wchar_t|int|struct|double|float)\s+\w+\s*\[\s*\d+\s*\]"),
    ("CWE-122", COPY, ALLOCATES),
    ("CWE-124", COPY, NEGATIVE),
    ("CWE-124", r"\b\w+\s*<\s*\d+", r"\[[^\]]*[A-Za-z_]\w*[^\]]*\]\s*="),
    ("CWE-126", COPY),
    ("CWE-126", r"(?:print\w*Line|fwrite|send)\s*\("),
    ("CWE-126", r"\w+\s*\[[^\]]+\]\s*=\s*\w+\s*\[[^\]]+\]"),
    ("CWE-127", COPY, r"(?:\+\s*-\s*(?:1|2|4|8)|-\s*(?:1|2|4|8)|0xffffffff|buffer\s*\[\s*data\s*\])"),
    ("CWE-127", r"print\w*Line\s*\(", r"(?:\+\s*-\s*(?:1|2|4|8)|-\s*(?:1|2|4|8)|0xffffffff|buffer\s*\[\s*data\s*\])"),
    ("CWE-134", r"\b(?:\w*printf|syslog)\s*\("),
    ("CWE-190", r"\b(?:result|data)\b[^;]*(?:\+|\*|<<)[^;]*;"),
    ("CWE-191", r"\b(?:result|data)\b[^;]*(?:--|\+\s*-\s*1|-\s*1)[^;]*;"),
    ("CWE-194 CWE-195 CWE-197", r"\bdata\b[^;]*(?:\(?(?:char|short|int|long)\)?|SUB\d+|CONCAT\d+)"),
    ("CWE-195", r"(?:malloc|calloc|realloc|memcpy|memmove)[^;]*\((?:u?int|u?long|u?short|u?char|size_t)\)[^;]*\bdata\b"),
    ("CWE-369", r"\b(?:result|data)\b[^;]*(?:/|%)[^;]*;"),
    ("CWE-400", r"(?:while\s*\(|for\s*\(|malloc|calloc|new|u?sleep|socket|connect|accept)"),
    ("CWE-401", ALLOCATES, "!" + RELEASES),
    ("CWE-404", r"(?:fopen|open\s*\()", r"(?:fclose|close\s*\()"),
    ("CWE-427", r"(?:system|popen|execl|execv|loadlibrary|createprocess)"),
    ("CWE-457", r"\b(?:print\w*Line|printf)\s*\([^;]*(?:\*?data|dataUninit)"),
    ("CWE-457", ALLOCATES, r"print\w*Line\s*\([^;]*(?:\*|\+\s*\(long\)|\[)"),
    ("CWE-464", r"(?:memset|memcpy|strcpy|strncpy|\[[^\]]+\]\s*=)"),
    ("CWE-588", r"(?:printStructLine|->|\*\s*\([A-Za-z_].*\))"),
    ("CWE-590", RELEASES, r"(?-i)(?:local_|\[[^\]]+\]|&)"),
    ("CWE-606", r"(?-i)(?:while\s*\(|for\s*\()", r"(?:fgets|scanf|recv|data)"),
    ("CWE-617", r"(?:assert|abort|__assert_fail)"),
    ("CWE-665", r"(?:memcpy|memmove|strcpy|strncpy|print\w*Line|printf)"),
    ("CWE-672", RELEASES, r"(?:print|->|\*\s*[A-Za-z_])"),
    ("CWE-680", r"\b(?:data|result)\b[^;]*(?:\*|<<)[^;]*;", r"(?:malloc|calloc|memset|memcpy)"),
    ("CWE-690", ALLOCATES, r"(?:->|\*\s*[A-Za-z_]|\[[^\]]+\]\s*=)"),
    ("CWE-761", RELEASES, r"(?:\+\+|--|\+=|-=)"),
    ("CWE-762", C_ALLOCATES, CPP_RELEASES),
    ("CWE-762", CPP_ALLOCATES, C_RELEASES),
    ("CWE-773 CWE-775", r"(?:fopen|open\s*\(|socket)"),
    ("CWE-789", ALLOCATES, r"(?:rand|scanf|fgets|recv|strtoul|atoi|input|data)"),
]

#: Points of a line that is an operation: the first rule that fits decides.
OPERATIONS = [
    ("CWE-121 CWE-122", 30, COPY),
    ("CWE-121 CWE-122", 28, r"\bw?memset\s*\("),
    ("CWE-121 CWE-122", 20, VARIABLE_ELEMENT),
    ("CWE-121 CWE-122", 4, CONSTANT_ELEMENT),
    ("CWE-121 CWE-122", 10),
    ("CWE-126", 36, r"\bdata\s*=\s*dataBadBuffer\s*;"),
    ("CWE-126", 34, r"\w+\s*\[[^\]]+\]\s*=\s*data\s*\[[^\]]+\]"),
    ("CWE-126", 34, r"\w+\s*\[[^\]]+\]\s*=\s*\*\s*\([^;]+\)"),
    ("CWE-126", 30, COPY),
    ("CWE-126", 8, CONSTANT_ELEMENT),
    ("CWE-126", 18),
    ("CWE-124 CWE-127", 35, NEGATIVE, r"\bdata\b|[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*"),
    ("CWE-124 CWE-127", 35, COPY, NEGATIVE),
    ("CWE-124 CWE-127", 28, VARIABLE_ELEMENT),
    ("CWE-124 CWE-127", 16, COPY),
    ("CWE-124 CWE-127", 3, CONSTANT_ELEMENT),
    ("CWE-124 CWE-127", 10),
    ("CWE-23 CWE-36", 35, r"(?:fopen|open|remove|rename|realpath)\s*\("),
    ("CWE-23 CWE-36", 32, r"(?:fgets|recv|read|getenv)\s*\("),
    ("CWE-23 CWE-36", 28, r"(?:strcat|strncat)\s*\("),
    ("CWE-23 CWE-36", 0),
    ("CWE-190", 32, "!" + DECLARATION, r"\b(?:data|result)\b|print\w*line", r"(?:\+|\*|<<)"),
    ("CWE-190", 0),
    ("CWE-191", 32, r"\b(?:data|result)\b|print\w*line", r"(?:--|-\s*\d|\+\s*-\s*\d)"),
    ("CWE-191", 0),
    ("CWE-194 CWE-195 CWE-197", 0, DECLARATION),
    ("CWE-195", 35, r"(?:malloc|calloc|realloc|memcpy|memmove)[^;]*\bdata\b"),
    ("CWE-194 CWE-195 CWE-197", 30, CASTS),
    ("CWE-194 CWE-195 CWE-197", 0),
    ("CWE-134", 32),
    ("CWE-400", 34, r"(?:u?sleep|while\s*\(|for\s*\()"),
    ("CWE-400", 30, r"(?:recv|fgets|scanf|atoi)\s*\("),
    ("CWE-400", 24, r"(?:socket|connect|accept|malloc|calloc|new)\b"),
    ("CWE-400", 0),
    ("CWE-789", 36, ALLOCATES),
    ("CWE-789", 32, r"(?:recv|fgets|scanf|strtoul|atoi)\s*\("),
    ("CWE-789", 0),
    ("CWE-401", 30),
    ("CWE-457", 0, DECLARATION),
    ("CWE-457", 32, _PRINTS + r"|memcpy|memmove)\s*\("),
    ("CWE-457", 18, r"(?:\*\s*[A-Za-z_]|\[[^\]]+\])"),
    ("CWE-457", 0),
    ("CWE-588", 0, DECLARATION),
    ("CWE-588", 32, r"(?:printStructLine|->)"),
    ("CWE-588", 20, r"\*\s*\([A-Za-z_]"),
    ("CWE-588", 0),
    ("CWE-672", 35, RELEASES),
    ("CWE-672", 0, DECLARATION),
    ("CWE-672", 28, _PRINTS + r"|->|\[[^\]]+\]|\*\s*[A-Za-z_])"),
    ("CWE-672", 0),
    ("CWE-680", 0, DECLARATION),
    ("CWE-680", 34, _DATA_OR_RESULT, r"(?:\*|<<)"),
    ("CWE-680", 24, ALLOCATES),
    ("CWE-680", 0),
    ("CWE-690", 34, ALLOCATES),
    ("CWE-690", 0, DECLARATION),
    ("CWE-690", 26, r"(?:->|\[[^\]]+\]\s*=|\*\s*[A-Za-z_])"),
    ("CWE-690", 0),
    ("CWE-762", 30),
    ("*", 20),
]
#: Points of a line that is no operation, but tests one.
TESTS = [("CWE-124 CWE-127", 18, r"\bdata\s*(?:>=|>)\s*0|\bdata\s*<\s*\d+")]

#: Points of a line that limits or mends an operation. From STRONG on it is strong evidence.
STRONG = 40
CONTROLS = [
    ("*", 0, DECLARATION),
    ("CWE-23 CWE-36", 46, r"(?:strcpy|strncpy|strcat|strncat|wcscpy|wcsncpy|wcscat|wcsncat|builtin_w?csncpy)\s*\([^;]*" + LITERAL),
    ("CWE-23 CWE-36", 44, r"(?:realpath|canonical)"),
    ("CWE-124 CWE-127", 48, r"\bdata\s*=\s*(?:dataBuffer|dataGoodBuffer|\w*Good\w*)\s*;"),
    ("CWE-124 CWE-127", 44, ALLOCATES, NUMBER),
    ("CWE-124 CWE-127", 46, IF, r"(?:>=\s*0|>\s*0|<\s*(?:0x[0-9a-f]+|\d+))"),
    ("CWE-121 CWE-122", 48, COPY, r"\bsizeof\s*\("),
    ("CWE-121 CWE-122", 46, r"\bw?memset\s*\([^;]*(?:0x[0-9a-f]+|\d+)\s*\)"),
    ("CWE-121 CWE-122", 44, ALLOCATES, NUMBER),
    ("CWE-126 CWE-127", 48, r"\bdata\s*=\s*(?:dataGoodBuffer|\w*Good\w*)\s*;"),
    ("CWE-400", 46, IF, r"(?:count|size|length|data).*(?:<|>|<=|>=)"),
    ("CWE-400", 42, r"\b(?:count|size|length|data)\s*=\s*(?:0x[0-9a-f]+|\d+)\s*;"),
    ("CWE-78", 48, r"\b(?:data|data_buf|dataBuffer)(?:\._\w+)?\s*=\s*(?:__?LC\w*|_UNK_\w+|L?" + LITERAL + r")\s*;"),
    ("CWE-78", 44, r"(?:strcpy|strncpy|wcscpy|wcsncpy|wcscat|strcat)\s*\([^;]*(?:__?LC\w*|L?" + LITERAL + ")"),
    ("CWE-401", 48, RELEASES),
    ("CWE-194 CWE-195 CWE-197", 46, r"\bdata\s*=\s*(?:0x[0-9a-f]+|\d+)\s*;"),
    ("CWE-194 CWE-195 CWE-197", 42, IF, r"\bdata\b.*(?:>=\s*0|>\s*0|<\s*\d+)"),
    ("CWE-134", 48, r"\b\w*printf\s*\([^;]*\"(?:%s|%ls)\""),
    ("CWE-134", 44, r"(?:strcpy|strncpy|wcscpy|wcsncpy)\s*\([^;]*" + LITERAL),
    ("CWE-457", 46, r"\bdata\s*=\s*(?:L?\"|0x[0-9a-f]+|\d+|malloc|calloc|new\b)"),
    ("CWE-457", 48, r"\*\s*[A-Za-z_]\w*\s*=\s*(?:_LC\w*|_LCPI\w*|0x[0-9a-f]+|\d+|L?" + LITERAL + r")\s*;"),
    ("CWE-457", 46, r"(?:\w+\s*\[[^\]]+\]\s*\.\s*\w+|\w+\s*\[[^\]]+\])\s*=\s*(?:\w+|0x[0-9a-f]+|\d+)\s*;"),
    ("CWE-457", 48, r"^\*\s*\([^=]+\)\s*=\s*(?:\([^)]+\))?\s*(?:\w+|0x[0-9a-f]+|\d+)\s*;"),
    ("CWE-590 CWE-762", 46, "(?:" + ALLOCATES + "|" + RELEASES + ")"),
    ("CWE-190 CWE-191 CWE-680", 46, IF, r"\b(?:data|result)\b.*(?:<|>|==|!=)"),
    ("CWE-606", 46, IF, r"\b(?:n|count|data)\b.*(?:<|>|<=|>=)\s*(?:0x[0-9a-f]+|\d+)"),
    ("CWE-789", 48, IF, r"(?:99|100|0x64).*(?:<|>)|(?:<|>).*?(?:99|100|0x64)"),
    ("CWE-789", 42, ALLOCATES, NUMBER),
    ("CWE-404 CWE-775", 46, r"(?:fclose|close)\s*\("),
    ("CWE-590 CWE-672 CWE-761 CWE-762", 42, r"(?:free|delete|operator_delete)\b"),
    ("*", 24, IF, r"(?:<|>|==|!=|<=|>=)"),
    ("*", 18, r"=\s*(?:0x[0-9a-f]+|\d+|L?" + LITERAL + r")\s*;"),
    ("*", 0),
]
#: Sinks that are taken before all others, where there are any.
SINKS = [
    ("CWE-121 CWE-122 CWE-124 CWE-126 CWE-127", COPY),
    ("CWE-194 CWE-195", r"(?:memcpy|memmove|strncpy|malloc|calloc|realloc)[^;]*\bdata\b"),
    ("CWE-690", MEMBER_OR_ELEMENT, "!" + ALLOCATES),
]
#: Points that the best operation of a positive must have; of all others 10.
LEAST_POINTS = {"CWE-121": 28, "CWE-122": 28, "CWE-124": 28, "CWE-126": 28, "CWE-127": 28}

STRICT = ["CWE-121", "CWE-122", "CWE-124", "CWE-126", "CWE-127", "CWE-134", "CWE-190", "CWE-191", "CWE-194", "CWE-195", "CWE-457", "CWE-690"]
#: What each further strict contract leaves out of the one before, after a review by hand.
QUARANTINED = {"v2-strict-v4": ["CWE-124", "CWE-127", "CWE-457", "CWE-690"], "v2-strict-v5": ["CWE-121"], "v2-strict-v6": ["CWE-122"], "v2-strict-v7": ["CWE-126"]}
CONTRACTS = ["v1", "v2", "v2-strict", *QUARANTINED]
NO_NAMES = ["char", "double", "float", "int", "long", "short", "signed", "size_t", "undefined", "unsigned", "void", "wchar_t"]
