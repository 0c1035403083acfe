"""Grammars of the five languages over the token kinds of ``lexers``.

Operator precedence never decides whether a program is valid, so binary expressions are flat lists.  Where a rule name
ends in ``H`` it is the form for statement headers, in which Go and Rust do not take ``name {`` for a literal.
A rule marked ``%`` is a statement whose seen forms are remembered across files.
"""

from __future__ import annotations

from functools import cache

from . import lexers as L
from .peg import Peg

GO = r"""
File      <- 'package' ID SEMI (Import SEMI)* (Top SEMI)* EOF
Import    <- 'import' (ImportOne / '(' (ImportOne (SEMI ImportOne)* SEMI?)? ')')
ImportOne <- ('.' / ID)? STR
Top       <- Func / Decl
Func      <- 'func' Params? ID TypeParams? Signature Block?
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Names Constraint
Names     <- ID (',' ID)*
Constraint <- '~'? Type ('|' '~'? Type)*
Params    <- '(' (Param (',' Param)* ','?)? ')'
Param     <- ID? '...' Type / ID Type / Type
Signature <- Params (Params / Type)?
Type      <- '*' Type / '[' (']' / '...' ']' / Expr ']') Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type
           / 'func' Signature / Struct / Interface / '(' Type ')' / ID ('.' ID)? TypeArgs?
TypeArgs  <- '[' Type (',' Type)* ','? ']'
Struct    <- 'struct' '{' (Field SEMI)* Field? '}'
Field     <- (Names Type / '*'? ID ('.' ID)? TypeArgs?) STR?
Interface <- 'interface' '{' (Element SEMI)* Element? '}'
Element   <- ID Signature / Constraint
Decl      <- 'const' (ConstSpec / '(' (ConstSpec SEMI)* ConstSpec? ')') / 'var' (VarSpec / '(' (VarSpec SEMI)* VarSpec? ')')
           / 'type' (TypeSpec / '(' (TypeSpec SEMI)* TypeSpec? ')')
ConstSpec <- Names (Type? '=' Exprs)?
VarSpec   <- Names ('=' Exprs / Type ('=' Exprs)?)
TypeSpec  <- ID TypeParams? '='? Type
Block     <- '{' Stmts '}'
Stmts     <- Line*
%Line     <- SEMI / Stmt (SEMI / &'}' / &'case' / &'default')
Stmt      <- Decl / ID ':' Stmt? / 'go' Expr / 'defer' Expr / 'return' Exprs? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough'
           / Block / If / For / Switch / Select / Simple
Simple    <- Exprs (Assign Exprs / '++' / '--' / '<-' Expr)?
Assign    <- ':=' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
SimpleH   <- ExprsH (Assign ExprsH / '++' / '--' / '<-' ExprH)?
If        <- 'if' (SimpleH? SEMI)? ExprH Block ('else' (If / Block))?
For       <- 'for' ((ExprsH (':=' / '='))? 'range' ExprH / SimpleH? SEMI ExprH? SEMI SimpleH? / ExprH)? Block
Switch    <- 'switch' (SimpleH? SEMI)? SimpleH? '{' (('case' Exprs / 'default') ':' Stmts)* '}'
Select    <- 'select' '{' (('case' Simple / 'default') ':' Stmts)* '}'
Exprs     <- Expr (',' Expr)*
ExprsH    <- ExprH (',' ExprH)*
Expr      <- Unary (Binary Unary)*
ExprH     <- UnaryH (Binary UnaryH)*
Binary    <- '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
Prefix    <- '+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~'
Unary     <- Prefix* Operand Suffix*
UnaryH    <- Prefix* OperandH Suffix*
Operand   <- NUM / STR / CHAR / 'func' Signature Block / ID ('.' ID)? TypeArgs? Braced / ID / TypeLit Braced? / '(' (Expr / Type) ')'
OperandH  <- NUM / STR / CHAR / 'func' Signature Block / ID / TypeLit Braced? / '(' (Expr / Type) ')'
TypeLit   <- &('[' / 'map' / 'chan' / 'struct' / 'interface' / 'func') Type
Suffix    <- '.' ID / '.' '(' ('type' / Type) ')' / '[' (Expr? ':' Expr? (':' Expr)? / Arg (',' Arg)* ','?) ']' / '(' Flat? ')' / '(' Arg (',' Arg)* '...'? ','? ')'
Arg       <- Expr / Type
Flat      <- One (',' One)* ','?
One       <- NUM / STR / CHAR / ID ('.' ID)*
Braced    <- '{' Flat? '}' / '{' Item (',' Item)* ','? '}'
Item      <- (Expr / Braced) (':' (Expr / Braced))?
"""

RUST = r"""
File      <- InnerAttr* Item* EOF
InnerAttr <- '#' '!' '[' Trees ']'
Attr      <- '#' '[' Trees ']' / DOC
Trees     <- Tree*
Tree      <- '(' Trees ')' / '[' Trees ']' / '{' Trees '}' / !( '(' / ')' / '[' / ']' / '{' / '}' / EOF ) Any
Any       <- ANY
Item      <- Attr* Vis? ItemKind
Vis       <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' Path) ')')?
ItemKind  <- 'use' UseTree ';' / 'mod' ID (';' / '{' InnerAttr* Item* '}') / 'extern' 'crate' (ID / 'self') ('as' (ID / '_'))? ';'
           / FnQual 'fn' Fn / ('unsafe' / 'safe')? 'static' 'mut'? ID ':' Type ('=' Expr)? ';' / 'const' (ID / '_') ':' Type ('=' Expr)? ';'
           / 'type' ID Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';'
           / 'struct' ID Generics? Where? (Fields / TupleFields Where? ';' / ';') / 'union' ID Generics? Where? Fields
           / 'enum' ID Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
           / 'unsafe'? 'auto'? 'trait' ID Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}'
           / 'default'? 'unsafe'? 'impl' Generics? ('!'? Type 'for')? Type Where? '{' InnerAttr* Item* '}'
           / 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}' / 'macro_rules' '!' ID (Braces / Parens ';') / MacroItem
MacroItem <- SimplePath '!' ID? (Braces / (Parens / Brackets) ';')
Braces    <- '{' Trees '}'
Parens    <- '(' Trees ')'
Brackets  <- '[' Trees ']'
UseTree   <- ('::')? (UsePart '::')* ('*' / '{' (UseTree (',' UseTree)* ','?)? '}' / UsePart ('as' (ID / '_'))?)
UsePart   <- ID / 'crate' / 'self' / 'super'
FnQual    <- 'default'? 'const'? 'async'? ('unsafe' / 'safe')? ('extern' STR?)?
Fn        <- ID Generics? '(' FnParams ')' ('->' Type)? Where? (';' / Block)
FnParams  <- (FnParam (',' FnParam)* ','?)?
FnParam   <- Attr* ('&' LIFE? 'mut'? 'self' / 'mut'? 'self' (':' Type)? / '...' / Pat ':' (Type / '...') / Type)
Generics  <- '<' (Generic (',' Generic)* ','?)? '>'
Generic   <- Attr* (LIFE (':' Bounds?)? / 'const' ID ':' Type ('=' GenericArg)? / ID (':' Bounds?)? ('=' Type)?)
Where     <- 'where' (WherePred (',' WherePred)* ','?)?
WherePred <- LIFE ':' Bounds? / ForLife? Type ':' Bounds?
ForLife   <- 'for' Generics
Bounds    <- Bound ('+' Bound)* '+'?
Bound     <- LIFE / 'use' '<' ((LIFE / ID / 'Self') (',' (LIFE / ID / 'Self'))* ','?)? '>' / '?'? ForLife? TypePath / '(' '?'? ForLife? TypePath ')'
Fields    <- '{' (NamedField (',' NamedField)* ','?)? '}'
NamedField <- Attr* Vis? ID ':' Type
TupleFields <- '(' (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)? ')'
Variant   <- Attr* Vis? ID (Fields / TupleFields)? ('=' Expr)?
Type      <- TypeOne
TypeOne   <- '(' (Type (',' Type)* ','?)? ')' / '!' / '&&' LIFE? 'mut'? TypeOne / '&' LIFE? 'mut'? TypeOne / '*' ('const' / 'mut') TypeOne
           / '[' Type (';' Expr)? ']' / '_' / ('impl' / 'dyn') Bounds / ForLife? FnQual 'fn' '(' (FnTypeArg (',' FnTypeArg)* ','?)? ')' ('->' TypeOne)?
           / ForLife? TypePath ('!' (Parens / Brackets / Braces))? / '<' Type ('as' TypePath)? '>' ('::' PathSeg)+
FnTypeArg <- Attr* (('_' / ID) ':')? (Type / '...')
TypePath  <- '::'? PathSeg ('::' PathSeg)*
PathSeg   <- (ID / 'self' / 'Self' / 'super' / 'crate') ('::'? GenericArgs / '(' (Type (',' Type)* ','?)? ')' ('->' TypeOne)?)?
GenericArgs <- '<' (GenericArg (',' GenericArg)* ','?)? '>'
GenericArg <- LIFE / ID GenericArgs? ('=' Type / ':' Bounds) / Type / '-'? (NUM / STR / CHAR / 'true' / 'false') / Block
Path      <- SimplePath
SimplePath <- '::'? (ID / 'self' / 'super' / 'crate' / 'Self') ('::' (ID / 'self' / 'super' / 'crate'))*
ExprPath  <- '::'? ExprSeg ('::' ExprSeg)* / '<' Type ('as' TypePath)? '>' ('::' ExprSeg)+
ExprSeg   <- (ID / 'self' / 'Self' / 'super' / 'crate') ('::' GenericArgs)?
Pat       <- '|'? PatOne ('|' PatOne)*
PatOne    <- ('&&' / '&') 'mut'? PatOne / 'ref'? 'mut'? ID !('::' / '(' / '{' / '!' / '..=' / '...') ('@' PatOne)? / '_' / '..=' PatLit / '..' !PatLit
           / PatLit (('..=' / '...' / '..') PatLit?)? / '(' (Pat (',' Pat)* ','?)? ')' / '[' (Pat (',' Pat)* ','?)? ']' / '..'
PatLit    <- '-'? NUM / STR / CHAR / 'true' / 'false' / ExprPath ('!' (Parens / Brackets / Braces) / '(' (Pat (',' Pat)* ','?)? ')' / '{' (PatField (',' PatField)* ','?)? '}')?
PatField  <- Attr* ('..' / (ID / NUM) ':' Pat / 'ref'? 'mut'? ID)
Block     <- '{' InnerAttr* BlockStmt* Tail? '}'
Tail      <- Attr* Expr
%BlockStmt <- ';' / Attr* 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' / Attr* BlockLike !('.' / '?') / Item / Attr* Expr ';'
BlockLike <- (LIFE ':')? ('if' If / 'match' Match / 'loop' Block / 'while' ExprH Block / 'for' Pat 'in' ExprH Block) / (LIFE ':')? ('unsafe' / 'const')? Block / 'async' 'move'? Block
           / SimplePath '!' Braces
If        <- ExprH Block ('else' ('if' If / Block))?
Match     <- ExprH '{' InnerAttr* (Arm)* '}'
Arm       <- Attr* Pat ('if' Expr)? '=>' (BlockLike !('.' / '?') ','? / Expr (',' / &'}'))
Expr      <- 'let' Pat '=' ExprH ('&&' Expr)? / Range / Unary (Binary Unary / 'as' TypeOne)* (('..=' / '..') (Unary (Binary Unary / 'as' TypeOne)*)?)? (AssignOp Expr)?
Range     <- ('..=' / '..') (Unary (Binary Unary / 'as' TypeOne)*)?
ExprH     <- 'let' Pat '=' UnaryH (BinaryL UnaryH / 'as' TypeOne)* (('&&') ExprH)? / ('..=' / '..') UnaryH? / UnaryH (Binary (&'let' ExprH / UnaryH) / 'as' TypeOne)* (('..=' / '..') (UnaryH (Binary UnaryH / 'as' TypeOne)*)?)? (AssignOp ExprH)?
Binary    <- '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' !'=' / '>' '=' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
BinaryL   <- '==' / '!=' / '<=' / '<<' / '<' / '>' '>' !'=' / '>' '=' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
AssignOp  <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / '<<=' / '>' '>' '='
Unary     <- ('-' / '!' / '*' / '&&' 'mut'? / '&' ('mut')?)* Primary Suffix*
UnaryH    <- ('-' / '!' / '*' / '&&' 'mut'? / '&' ('mut')?)* PrimaryH Suffix*
Suffix    <- '?' / '.' ('await' / NUM / ID ('::' GenericArgs)?) / '(' Flat? ')' / '(' Expr (',' Expr)* ','? ')' / '[' Expr ']'
Flat      <- One (',' One)* ','?
One       <- '&'? (NUM / STR / CHAR / ID)
Primary   <- ExprPath '{' (StructItem (',' StructItem)* ','?)? ('..' Expr)? '}' / PrimaryH
StructItem <- Attr* ('..' Expr / (ID / NUM) (':' Expr)?)
PrimaryH  <- NUM / STR / CHAR / 'true' / 'false' / Closure / BlockLike / ExprPath ('!' (Parens / Brackets / Braces))? / '(' (Attr* Expr (',' Expr)* ','?)? ')'
           / '[' Flat? ']' / '[' Expr (';' Expr / (',' Expr)* ','?) ']' / 'return' Expr? / 'break' LIFE? Expr? / 'continue' LIFE? / '_' / 'async' 'move'? Block
Closure   <- 'static'? 'async'? 'move'? ('||' / '|' (ClosureParam (',' ClosureParam)* ','?)? '|') ('->' TypeOne Block / Expr)
ClosureParam <- Attr* PatOne (':' Type)?
"""

JS = r"""
File      <- SEMI? Stmt* EOF
Stmts     <- Stmt*
End       <- SEMI / &'}' / &EOF
%Stmt     <- SEMI / Block / &('var' / 'const' / 'let') Vars End / &('async' / 'function') Function / &('@' / 'class' @/ 'abstract'@) Class / 'if' '(' Expr ')' VSEMI? Stmt (VSEMI? 'else' VSEMI? Stmt)? / For / 'while' '(' Expr ')' VSEMI? Stmt
           / 'do' VSEMI? Stmt VSEMI? 'while' '(' Expr ')' SEMI? / 'switch' '(' Expr ')' '{' SEMI* (('case' Expr / 'default') ':' Stmts)* '}'
           / 'try' Block ('catch' ('(' Binding Annot? ')')? Block ('finally' Block)? / 'finally' Block)
           / 'return' Expr? End / 'throw' Expr End / ('break' / 'continue') ID? End / 'debugger' End
           / &'import' Import / &('export' / '@') Export / @&('declare' / 'interface' / 'type' / 'const' / 'enum' / 'namespace' / 'module' / 'global' / 'abstract') Declared /@ ID ':' Stmt / Expr End
Block     <- '{' Stmts '}'
Vars      <- 'const' ConstVar (',' ConstVar)* / ('var' / 'let' !'let' &(ID / '{' / '[')) Var (',' Var)*
ConstVar  <- Binding @'!'? Annot? ('=' Assign)? / Binding@ '=' Assign
Var       <- Binding @'!'?@ Annot? ('=' Assign)?
For       <- 'for' 'await'? '(' (('var' / 'const' / 'let') Binding Annot? ('of' Assign / 'in' Expr) / Postfix ('of' Assign / 'in' Expr) / (Vars / Expr)? ';' Expr? ';' Expr?) ')' VSEMI? Stmt
Import    <- 'import' @'type'?@ (STR / (Names / ID (',' Names)?) 'from' STR) ('with' Object)? End @/ 'import' ID '=' Expr End@
Names     <- '*' 'as' ID / '{' (Name (',' Name)* ','?)? '}'
Name      <- @'type' (WORD / STR) ('as' (WORD / STR))? !(WORD) /@ (WORD / STR) ('as' (WORD / STR))?
Export    <- 'export' ('default' (Function / Class / @Interface /@ Assign End) / @('type')?@ '*' ('as' (WORD / STR))? 'from' STR End / @('type' &'{')?@ '{' (Name (',' Name)* ','?)? '}' ('from' STR)? End
           / Vars End / Function / Class @/ '=' Expr End / Declared1@) / Decorator+ 'export' 'default'? Class
Function  <- 'async'? 'function' '*'? ID? TParams? Params Ret? (Block @/ End@)
Params    <- '(' (Param (',' Param)* ','?)? ')'
Param     <- (&'@' Decorator)* @Modifier*@ '...'? @('this' Annot /@ Binding @'?'?@ Annot? ('=' Assign)? @)@
Binding   <- ID / '{' (BindProp (',' BindProp)* ','?)? '}' / '[' ','* (BindItem (','+ BindItem)* ','*)? ']'
BindProp  <- '...' Binding / PropName ':' Binding ('=' Assign)? / ID ('=' Assign)?
BindItem  <- '...' Binding / Binding ('=' Assign)?
Decorator <- '@' (ID ('.' WORD)* Args? / '(' Expr ')') VSEMI?
Class     <- (&'@' Decorator)* @'abstract'?@ 'class' @!('implements' ID)@ ID? TParams? ('extends' Postfix @TArgs?@)? @('implements' Type (',' Type)*)?@ '{' Member* '}'
Member    <- SEMI / 'static' Block / (&'@' Decorator)* (Accessor / MemberMod* (MemberFn / MemberField / @Index@))
MemberMod <- ('static' / 'async' / 'accessor' @/ Modifier / 'declare' / 'abstract'@) !('(' / '=' / ';' / VSEMI / '}' / ':' / '?' / '!' / '<' / ',') 
Modifier  <- ('public' / 'private' / 'protected' / 'readonly' / 'override') !(',' / ')' / ':' / '=' / '?' / '(' / ';' / '!' / '<' )
Accessor  <- MemberMod* ('get' / 'set') PropName @'?'?@ Params Ret? (Block @/ End@)
MemberFn  <- '*'? PropName @'?'?@ TParams? Params Ret? (Block @/ End@)
MemberField <- PropName @('?' / '!')?@ Annot? ('=' Assign)? End
PropName  <- WORD / STR / NUM / '[' Assign ']' / '#' WORD
Expr      <- Assign (',' Assign)*
Assign    <- &('async' / '(' / '<' / ID '=>') Arrow / 'yield' ('*' Assign / Assign)? / @'<' Type '>' !'(' Assign /@ Unary (Binary Unary / '?' Assign ':' Assign @/ 'as' 'const' / ('as' / 'satisfies') Type@)* (AssignOp Assign)?
Arrow     <- 'async'? (ID / @TParams?@ Params Ret?) '=>' (Block / !'{' Assign)
Binary    <- '||' / '&&' / '??' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' !'=' / '>' '>' !'=' / '>' '=' / '>' / '+' / '-' / '**' / '*' / '/' / '%' / '&' / '|' / '^' / 'in' / 'instanceof'
AssignOp  <- '=' / '+=' / '-=' / '*=' / '**=' / '/=' / '%=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>' '>' '=' / '>' '>' '='
Unary     <- ('delete' / 'void' / 'typeof' / 'await' / '!' / '~' / '+' / '-' / '++' / '--')* Postfix
Postfix   <- Primary Suffix* ('++' / '--')?
Suffix    <- ('.' / '?.') (WORD / '#' WORD) / '?.'? '[' Expr ']' / '?.'? Args / Template @/ '!' !'=' / TArgs &('(' / TPL) / '?.' TArgs Args@
Args      <- '(' Flat? ')' / '(' Arg (',' Arg)* ','? ')'
Arg       <- '...'? Assign
Flat      <- One (',' One)* ','?
One       <- NUM / STR / ID ('.' WORD)*
Template  <- TPL (SUB Expr ENDSUB)*
Primary   <- NAME / NUM / STR / RE / Template / 'this' / 'null' / 'true' / 'false' / 'super' / 'new' '.' WORD / 'new' Primary NewSuffix* @TArgs?@ Args? / &('async' / 'function') Function1 / &('@' / 'class') Class / 'import' (Args / '.' WORD) / Array / Object / '(' Expr ')'
           / '#' WORD &'in' / ID
NewSuffix <- '.' (WORD / '#' WORD) / '[' Expr ']' / Template
Function1 <- 'async'? 'function' '*'? ID? TParams? Params Ret? Block
Array     <- '[' Flat? ']' / '[' ','* (Arg (','+ Arg)* ','*)? ']'
Object    <- '{' Pairs? '}' / '{' Prop (',' Prop)* ','? '}'
Pairs     <- Pair (',' Pair)* ','?
Pair      <- (WORD / STR) ':' (NUM / STR / ID)
Prop      <- '...' Assign / PropName ':' Assign / ('async' / 'get' / 'set')? '*'? PropName TParams? Params Ret? Block / ID ('=' Assign)?
"""

_TS_ONLY = r"""
Annot     <- ':' Type
Ret       <- ':' Predicate
Predicate <- 'asserts' (ID / 'this') ('is' Type)? / (ID / 'this') 'is' Type / Type
TParams   <- '<' TParam (',' TParam)* ','? '>'
TParam    <- ('const' / 'in')* (ID &ID)? ID ('extends' Type)? ('=' Type)?
TArgs     <- '<' Type (',' Type)* ','? '>'
Type      <- FnType / Union ('extends' Union '?' Type ':' Type)?
FnType    <- &('abstract' / 'new' / '(' / '<') FnType1
FnType1   <- 'abstract'? 'new' TParams? Params '=>' Type / TParams? Params '=>' Predicate
Union     <- '|'? Inter ('|' Inter)*
Inter     <- '&'? TPost ('&' TPost)*
TPost     <- ('keyof' / 'readonly' / 'unique' / 'infer')  TPost / TPrim ('[' Type? ']')*
TPrim     <- '(' Type ')' / '{' MappedType '}' / '{' TMember* '}' / '[' (TItem (',' TItem)* ','?)? ']' / STR / '-'? NUM / Template1 / 'null' / 'this' / 'void' / 'true' / 'false'
           / 'typeof' ('import' '(' STR ')' ('.' WORD)* / (ID / 'this') ('.' (WORD / '#' WORD))*) TArgs? / 'import' '(' STR ')' ('.' WORD)* TArgs? / ID ('.' WORD)* TArgs?
Template1 <- TPL (SUB Type ENDSUB)*
TItem     <- '...'? (ID '?'? ':' Type / Type '?'?)
MappedType <- SEMI? (('+' / '-')? 'readonly')? '[' ID 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? Annot? SEMI?
TMember   <- SEMI / ((('get' / 'set') PropName Params Ret? / 'readonly'? Index1 / 'new' TParams? Params Ret? / TParams? Params Ret? / 'readonly' PropName '?'? Annot? / PropName '?'? (TParams? Params Ret? / Annot?)) (SEMI / ',' / &'}'))
Index1    <- '[' ID ':' Type ']' Annot
Index     <- Index1 End
Interface <- 'interface' ID TParams? ('extends' Type (',' Type)*)? '{' TMember* '}'
Declared  <- Declared1
Declared1 <- 'declare' (Vars End / Function / Class / Declared1) / Interface / 'type' ID TParams? '=' Type End / 'const'? 'enum' ID '{' (PropName ('=' Assign)? (',' PropName ('=' Assign)?)* ','?)? '}'
           / ('namespace' / 'module') (ID ('.' ID)* / STR) (Block / End) / 'global' Block / 'abstract' Class
"""

_JS_ONLY = r"""
Annot     <- !ANY1 EOF
Ret       <- !ANY1 EOF
TParams   <- !ANY1 EOF
"""

PYTHON = r"""
File      <- Stmts EOF
Stmts     <- Stmt*
%Stmt     <- NL / Compound / Simple (';' Simple)* ';'? NL
Simple    <- 'pass' / 'break' / 'continue' / 'return' Stars? / 'raise' (Test ('from' Test)?)? / ('global' / 'nonlocal') ID (',' ID)* / 'del' Targets
           / 'assert' Test (',' Test)? / 'import' DotAs (',' DotAs)* / 'from' ('.' / '...')* (Dotted / &'import') 'import' ('*' / '(' NameAs (',' NameAs)* ','? ')' / NameAs (',' NameAs)*)
           / 'type' ID TParams? '=' Test / Assign
Dotted    <- ID ('.' ID)*
DotAs     <- Dotted ('as' ID)?
NameAs    <- ID ('as' ID)?
Assign    <- Target ':' Test ('=' (Yield / Stars))? / Target AugOp (Yield / Test (',' Test)* ','?) / (Targets '=' !'=')* (Yield / Stars)
AugOp     <- '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
Target    <- &(ID / '(' / '[' / STR / '{' / FMT) Postfix
Targets   <- TargetOne (',' TargetOne)* ','?
TargetOne <- '*'? (ID !('(' / '[' / '.') / Postfix1 / '(' Targets? ')' / '[' Targets? ']')
Postfix1  <- 'await'? Atom ((Args / '[' Slices ']' / '.' ID) &('(' / '[' / '.'))* ('[' Slices ']' / '.' ID)
Compound  <- Decorator* ('async'? 'def' ID TParams? '(' Params ')' ('->' Test)? ':' Suite / 'class' ID TParams? ('(' ArgList? ')')? ':' Suite)
           / 'if' Named ':' Suite ('elif' Named ':' Suite)* ('else' ':' Suite)? / 'while' Named ':' Suite ('else' ':' Suite)?
           / 'async'? 'for' Targets 'in' Stars ':' Suite ('else' ':' Suite)? / 'async'? 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Suite
           / 'try' ':' Suite (('except' '*'? (Test ('as' ID / (',' Test)+)?)? ':' Suite)+ ('else' ':' Suite)? ('finally' ':' Suite)? / 'finally' ':' Suite)
           / 'match' Stars1 ':' NL IN ('case' Patterns ('if' Named)? ':' Suite)+ OUT
Decorator <- '@' Named NL
Suite     <- NL IN Stmt+ OUT / Simple (';' Simple)* ';'? NL
WithItem  <- Test ('as' (Target / '(' Targets? ')'))?
TParams   <- '[' TParam (',' TParam)* ','? ']'
TParam    <- ('**' / '*')? ID (':' Test)? ('=' Test)?
Params    <- (PosParams (',' StarParams)? ','? / StarParams ','?)?
PosParams <- Plain (',' Plain)* (',' '/' (',' Plain)* (',' Default)* / (',' Default)+ (',' '/' (',' Default)*)?)? / Default (',' Default)* (',' '/' (',' Default)*)?
StarParams <- '*' ID (':' '*'? Test)? (',' KeyOnly)* (',' Double)? / '*' (',' KeyOnly)+ (',' Double)? / Double
Plain     <- ID (':' Test)? !'='
Default   <- ID (':' Test)? '=' Test
KeyOnly   <- ID (':' Test)? ('=' Test)?
Double    <- '**' ID (':' Test)?
Lambda    <- 'lambda' (LPos (',' LStar)? ','? / LStar ','?)? ':' Test
LPos      <- LPlain (',' LPlain)* (',' '/' (',' LPlain)* (',' LDefault)* / (',' LDefault)+ (',' '/' (',' LDefault)*)?)? / LDefault (',' LDefault)* (',' '/' (',' LDefault)*)?
LStar     <- '*' ID (',' LKey)* (',' '**' ID)? / '*' (',' LKey)+ (',' '**' ID)? / '**' ID
LPlain    <- ID !'='
LDefault  <- ID '=' Test
LKey      <- ID ('=' Test)?
Patterns  <- PatOr (',' PatOr?)* 
PatOr     <- '*' ID / PatAlt ('as' ID)?
PatAlt    <- Pat ('|' Pat)*
Pat       <- '-'? NUM (('+' / '-') NUM)? / (STR / Fmt)+ / 'None' / 'True' / 'False' / '(' Patterns? ')' / '[' Patterns? ']' / '{' (PatKey (',' PatKey)* ','?)? '}' / ID ('.' ID)* ('(' (PatArg (',' PatArg)* ','?)? ')')?
PatKey    <- '**' ID / PatAlt ':' PatOr
PatArg    <- ID '=' PatOr / PatOr
Stars     <- Star (',' Star)* ','?
Stars1    <- Star (',' Star)* ','?
Star      <- '*' Arith / Named
Yield     <- 'yield' ('from' Test / Stars)?
Named     <- ID ':=' Test / Test
Test      <- Lambda / Logic ('if' Logic 'else' Test)?
Logic     <- 'not'* Compare (('and' / 'or') 'not'* Compare)*
Compare   <- Arith (CompOp Arith)*
CompOp    <- '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
Arith     <- Unary (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '<<' / '>>' / '&' / '|' / '^' / '**') Unary)*
Unary     <- ('+' / '-' / '~')* Postfix
Postfix   <- 'await'? Atom (Args / '[' Slices ']' / '.' ID)*
Args      <- '(' Flat? ')' / '(' ArgList ')'
Flat      <- One (',' One)* ','?
One       <- NUM / STR / ID ('.' ID)*
ArgList   <- Position (Comp / (',' Position)* (',' Keywords)? ','?) / Keywords ','?
Position  <- '*' Test / !(ID '=') Named
Keywords  <- KeyOrStar (',' KeyOrStar)* (',' KeyOrDouble)* / KeyOrDouble (',' KeyOrDouble)*
KeyOrStar <- ID '=' Test / '*' Test
KeyOrDouble <- ID '=' Test / '**' Test
Slices    <- Slice (',' Slice)* ','?
Slice     <- Test? ':' Test? (':' Test?)? / '*' Arith / Named
Comp      <- ('async'? 'for' Targets 'in' Logic ('if' (ID ':=' Test / Logic))*)+
Atom      <- (STR / Fmt)+ / NUM / 'None' / 'True' / 'False' / '...' / ID / '(' (Yield / Star (Comp / (',' Star)* ','?))? ')' / '[' Flat? ']' / '[' Star (Comp / (',' Star)* ','?) ']' / '{' Braced? '}'
Fmt       <- FMT (SUB (Yield / Stars) ENDSUB)*
Braced    <- ('**' Arith / Test ':' Test (Comp)?) (',' ('**' Arith / Test ':' Test))* ','? / Star (Comp / (',' Star)* ','?)
"""


def _script(kinds: dict[str, str], typed: bool) -> str:
    """The shared grammar with its ``@typed parts@`` kept or taken out."""
    parts = JS.split("@")
    # '@' is also the decorator token: it stands between quotes there, so those pieces are joined back
    out, typed_part, i = [], False, 0
    while i < len(parts):
        text = parts[i]
        if text.endswith("'") and i + 1 < len(parts) and parts[i + 1].startswith("'"):
            parts[i + 1] = text + "@" + parts[i + 1]
            i += 1
            continue
        if typed or not typed_part:
            out.append(text)
        typed_part = not typed_part
        i += 1
    return "".join(out) + (_TS_ONLY if typed else _JS_ONLY)


def _span(stop: str, open_: str, close: str, words: str, tails: str, after: str = "") -> str:
    """The statements that are remembered: one without a block; one that a block of such statements ends; one with a
    block inside that still ends in a terminator.  Each ends where no grammar rule looks further."""
    braces, run = open_ + close, r"{0,240}"
    block = f"[^{braces}\\0]{run}{open_}[^{braces}\\0]{run}{close}"
    return (
        f"[^{words}{braces}{stop}\\0][^{braces}{stop}\\0{words}]{run}[{stop}]"
        f"|[{words}]{block}(?:[{tails}]{block})*[{stop}]?(?![{tails}{after}])"
        f"|[^{words}{braces}{stop}\\0][^{braces}{stop}\\0]{run}{open_}[^{braces}\\0]{run}{close}[^{braces}{stop}\\0]{run}[{stop}]"
    )


def _of(kinds: dict[str, str], words: str) -> str:
    return "".join(kinds[w] for w in words.split())


LANGUAGES = ("go", "python", "javascript", "typescript", "rust")


@cache
def grammar(language: str, module: bool = True) -> Peg:
    if language == "go":
        return Peg(GO, L.GO, "File", _span(";" + L.VSEMI, "{", "}", _of(L.GO, "if for switch select case default func"), L.GO["else"]))
    if language == "rust":
        any_kind = "".join(dict.fromkeys("".join(v for k, v in L.RUST.items() if k != "EOF")))
        return Peg(RUST, L.RUST | {"ANY": any_kind}, "File", _span(";", "{", "}", _of(L.RUST, "if match loop while for"), L.RUST["else"], ".?;"))
    if language == "python":
        words = _of(L.PY, "if while for with try def class async match @")
        return Peg(PYTHON, L.PY, "File", _span(L.NEWLINE, L.INDENT, L.DEDENT, words, _of(L.PY, "else elif except finally")))
    typed = language == "typescript"
    kinds = L.JS | {"ANY1": "".join(dict.fromkeys("".join(v for k, v in L.JS.items())))}
    text = _script(kinds, typed)
    if not module:
        text = text.replace("/ &'import' Import / &('export' / '@') Export /", "/")
    words = _of(kinds, "if for while switch try function")
    return Peg(text, kinds, "File", _span(";" + L.VSEMI, "{", "}", words, _of(kinds, "else catch finally"), kinds["while"] + ";" + L.VSEMI))


LEXERS = {"go": L.GO_LEXER, "rust": L.RUST_LEXER, "python": L.PY_LEXER, "javascript": L.JS_LEXER, "typescript": L.JS_LEXER}
