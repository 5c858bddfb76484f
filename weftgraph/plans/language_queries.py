"""Extraction of every language as a query: a source file per nation, made from a template, and as SQL
the edges that the language's own rules give for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.model import table
from weftgraph.sources import extractors as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Name -> (suffix, template, edges as "relation | source | target | context"); {K} is the key of the nation, FILE the file.
FILES: dict[str, tuple[str, str, list[str]]] = {
    "c": (".c", '#include <stdio.h>\n#include "util{K}.h"\n/* int ghost(void) { } */\nstruct Point{K} {\n  int x;\n};\nstatic int helper{K}(int a) {\n  return a + 1; // fake{K}()\n}\nint main(int argc, char **argv) {\n  if (argc) {\n    printf("call(%d)", helper{K}(2));\n  }\n  return 0;\n}\n', [
        "imports|FILE|stdio_h|import", "imports|FILE|util{K}_h|import", "contains|FILE|Point{K}|", "contains|FILE|helper{K}()|", "contains|FILE|main()|",
        "calls|main()|helper{K}()|call"]),
    "cpp": (".cpp", '#include <vector>\nnamespace app {\nclass Shape{K} : public Base{K} {\n public:\n  int area() const { return side(); }\n  int side() const {\n    return 1;\n  }\n};\n}\nint Shape{K}::grow(Size{K} by) {\n  return area();\n}\nint run() {\n  const char* s = "class Fake {";\n  return 0;\n}\n', [
        "imports|FILE|vector|import", "contains|FILE|Shape{K}|", "inherits|Shape{K}|Base{K}|", "method|Shape{K}|.area()|", "method|Shape{K}|.side()|", "calls|.area()|.side()|call",
        "method|Shape{K}|.grow()|",
        "references|.grow()|Size{K}|parameter_type", "calls|.grow()|.area()|call", "contains|FILE|run()|"]),
    "java": (".java", 'package a.b;\nimport java.util.List;\n// class Ghost {}\npublic class Order{K} extends Base implements Runnable, Sized {\n  private Part{K} part;\n  public Order{K}(Part{K} p) {\n    init();\n  }\n  private void init() {\n    String s = "call(x)";\n  }\n  public Money total(Rate{K} r) throws Failure {\n    return r.apply(1);\n  }\n}\n', [
        "imports|FILE|java_util_list|import", "contains|FILE|Order{K}|", "inherits|Order{K}|Base|", "inherits|Order{K}|Runnable|", "inherits|Order{K}|Sized|",
        "references|Order{K}|Part{K}|field", "method|Order{K}|.Order{K}()|",
        "references|.Order{K}()|Part{K}|parameter_type", "method|Order{K}|.init()|", "calls|.Order{K}()|.init()|call", "method|Order{K}|.total()|",
        "references|.total()|Rate{K}|parameter_type", "references|.total()|Money|return_type", "references|.total()|Failure|return_type"]),
    "csharp": (".cs", 'using System.Text;\nnamespace A {\n  public class Cart{K} : Base, IThing {\n    private Item{K} item;\n    public void Add(Item{K} x) {\n      Check(x);\n    }\n    bool Check(Item{K} x) => true;\n  }\n}\n', [
        "imports|FILE|system_text|import", "contains|FILE|Cart{K}|", "inherits|Cart{K}|Base|", "inherits|Cart{K}|IThing|", "references|Cart{K}|Item{K}|field",
        "method|Cart{K}|.Add()|", "references|.Add()|Item{K}|parameter_type",
        "method|Cart{K}|.Check()|", "references|.Check()|Item{K}|parameter_type", "calls|.Add()|.Check()|call"]),
    "typescript": (".ts", "import { a, b } from './mod{K}';\nimport type { T } from 'types';\nexport * from \"./all\";\nconst lazy = () => {\n  return import('./late');\n};\nexport class View{K} extends Base implements Shown {\n  model: Model{K};\n  render(size: Size{K}): Html {\n    return this.draw(size);\n  }\n  private draw(size: Size{K}) {\n    return `fake(${size})`;\n  }\n}\nfunction helper{K}(x: number) {\n  if (x) { return other{K}(x); }\n}\nconst other{K} = (y) => {\n  return y;\n};\n", [
        "imports_from|FILE|mod{K}|import", "imports_from|FILE|types|import", "re_exports|FILE|all|import", "dynamic_import|FILE|late|import", "contains|FILE|lazy()|",
        "contains|FILE|View{K}|", "inherits|View{K}|Base|", "inherits|View{K}|Shown|",
        "references|View{K}|Model{K}|field", "method|View{K}|.render()|", "references|.render()|Size{K}|parameter_type", "references|.render()|Html|return_type",
        "method|View{K}|.draw()|", "references|.draw()|Size{K}|parameter_type",
        "calls|.render()|.draw()|call", "contains|FILE|helper{K}()|", "contains|FILE|other{K}()|", "calls|helper{K}()|other{K}()|call"]),
    "javascript": (".js", "const fs = require('fs{K}');\nclass Box{K} {\n  open() { return close{K}(); }\n}\nfunction close{K}() {\n  // open()\n  return 1;\n}\n", [
        "imports_from|FILE|fs{K}|import", "contains|FILE|Box{K}|", "method|Box{K}|.open()|", "contains|FILE|close{K}()|", "calls|.open()|close{K}()|call"]),
    "vue": (".vue", "<template><div @click=\"go()\">class Fake {</div></template>\n<script lang=\"ts\">\nimport X from './x{K}';\nfunction go{K}() {\n  return 1;\n}\n</script>\n",
    ["imports_from|FILE|x{K}|import", "contains|FILE|go{K}()|"]),
    "svelte": (".svelte", "<script>\nimport { onMount } from 'svelte';\nfunction start{K}() { return 2; }\n</script>\n<h1>function fake() {}</h1>\n",
    ["imports_from|FILE|svelte|import", "contains|FILE|start{K}()|"]),
    "astro": (".astro", "---\nimport Card from '../c{K}.astro';\nfunction pick{K}() { return 3; }\n---\n<Card />\n",
    ["imports_from|FILE|c{K}_astro|import", "contains|FILE|pick{K}()|"]),
    "go": (".go", 'package main\n\nimport (\n\t"fmt"\n\tlog "example.org/log{K}"\n)\n\ntype Server{K} struct {\n\tport int\n}\n\nfunc (s *Server{K}) Start(c Config{K}) error {\n\tfmt.Println("f(")\n\treturn s.listen()\n}\n\nfunc (s *Server{K}) listen() error {\n\treturn nil\n}\n\nfunc main() {\n\tbuild{K}()\n}\n\nfunc build{K}() {\n}\n', [
        "imports_from|FILE|fmt|import", "imports_from|FILE|example_org_log{K}|import", "contains|FILE|Server{K}|", "method|Server{K}|.Start()|",
        "references|.Start()|Config{K}|parameter_type", "method|Server{K}|.listen()|",
        "calls|.Start()|.listen()|call", "contains|FILE|main()|", "contains|FILE|build{K}()|", "calls|main()|build{K}()|call"]),
    "rust": (".rs", 'use std::collections::HashMap;\n\npub struct Node{K} {\n    id: u32,\n}\n\npub trait Named{K} {\n}\n\nimpl Named{K} for Node{K} {\n    fn name(&self) -> Label {\n        format(self.id)\n    }\n}\n\nfn format(id: u32) -> u32 {\n    id\n}\n', [
        "imports_from|FILE|std_collections_hashmap|import", "contains|FILE|Node{K}|", "contains|FILE|Named{K}|", "inherits|Node{K}|Named{K}|", "method|Node{K}|.name()|",
        "references|.name()|Label|return_type", "contains|FILE|format()|", "calls|.name()|format()|call"]),
    "kotlin": (".kt", "import a.b.C\n\nclass Repo{K}(val x: Int) : Base(), Named {\n    fun load(id: Key{K}): Row {\n        return read(id)\n    }\n    private fun read(id: Key{K}): Row {\n        return id\n    }\n}\n\nfun top{K}() {\n}\n", [
        "imports|FILE|a_b_c|import", "contains|FILE|Repo{K}|", "inherits|Repo{K}|Base|", "inherits|Repo{K}|Named|", "method|Repo{K}|.load()|",
        "references|.load()|Key{K}|parameter_type", "references|.load()|Row|return_type",
        "method|Repo{K}|.read()|", "references|.read()|Key{K}|parameter_type", "references|.read()|Row|return_type", "calls|.load()|.read()|call", "contains|FILE|top{K}()|"]),
    "scala": (".scala", "import scala.util.Try\n\nclass Job{K}(n: Int) extends Task with Timed {\n  def run(x: Input{K}): Output = {\n    step(x)\n  }\n  def step(x: Input{K}): Output = {\n    x\n  }\n}\n", [
        "imports|FILE|scala_util_try|import", "contains|FILE|Job{K}|", "inherits|Job{K}|Task|", "inherits|Job{K}|Timed|", "method|Job{K}|.run()|",
        "references|.run()|Input{K}|parameter_type", "references|.run()|Output|return_type",
        "method|Job{K}|.step()|", "references|.step()|Input{K}|parameter_type", "references|.step()|Output|return_type", "calls|.run()|.step()|call"]),
    "swift": (".swift", "import Foundation\n\nclass Screen{K}: View, Themed {\n    let model: Model{K}\n    func show(at p: Place{K}) -> Frame {\n        return layout()\n    }\n    func layout() {\n    }\n}\n", [
        "imports|FILE|foundation|import", "contains|FILE|Screen{K}|", "inherits|Screen{K}|View|", "inherits|Screen{K}|Themed|", "references|Screen{K}|Model{K}|field",
        "method|Screen{K}|.show()|", "references|.show()|Place{K}|parameter_type",
        "references|.show()|Frame|return_type", "method|Screen{K}|.layout()|", "calls|.show()|.layout()|call"]),
    "php": (".php", "<?php\nuse App\\Models\\User;\nrequire_once 'boot{K}.php';\nclass Page{K} extends Controller implements Viewable {\n  public function show($id) {\n    return $this->find($id);\n  }\n  private function find($id) {\n    return 'find()';\n  }\n}\nfunction helper{K}() {\n}\n", [
        "imports|FILE|app_models_user|import", "imports_from|FILE|boot{K}_php|import", "contains|FILE|Page{K}|", "inherits|Page{K}|Controller|", "inherits|Page{K}|Viewable|",
        "method|Page{K}|.show()|", "method|Page{K}|.find()|", "calls|.show()|.find()|call", "contains|FILE|helper{K}()|"]),
    "zig": (".zig", 'const std = @import("std");\nconst Vec{K} = struct {\n    x: f32,\n    pub fn len(self: Vec{K}) f32 {\n        return root(self.x);\n    }\n};\nfn root(x: f32) f32 {\n    return x;\n}\n', [
        "imports_from|FILE|std|import", "contains|FILE|Vec{K}|", "method|Vec{K}|.len()|", "contains|FILE|root()|", "calls|.len()|root()|call"]),
    "powershell": (".ps1", "Import-Module Net{K}\n# function Ghost {}\nfunction Get-Thing{K} {\n  Write-Log{K} 'x'\n}\nfunction Write-Log{K}($m) {\n  $m\n}\n", [
        "imports_from|FILE|net{K}|import", "contains|FILE|Get-Thing{K}()|", "contains|FILE|Write-Log{K}()|", "calls|Get-Thing{K}()|Write-Log{K}()|call"]),
    "objc": (".m", '#import <Foundation/Foundation.h>\n#import "Card{K}.h"\n@implementation Card{K}\n- (void)open {\n  [self turn];\n}\n- (void)turn {\n  NSLog(@"[self open]");\n}\n@end\n', [
        "imports|FILE|foundation_foundation_h|import", "imports|FILE|card{K}_h|import", "contains|FILE|Card{K}|", "method|Card{K}|.open()|", "method|Card{K}|.turn()|",
        "calls|.open()|.turn()|call"]),
    "ruby": (".rb", "require 'json'\nrequire_relative 'lib{K}'\n\nclass Cart{K} < Base\n  def add(x)\n    check(x)\n  end\n\n  def check(x)\n    if x\n      puts 'add(x)'\n    end\n  end\nend\n\ndef top{K}(y)\n  y\nend\n", [
        "imports_from|FILE|json|import", "imports_from|FILE|lib{K}|import", "contains|FILE|Cart{K}|", "inherits|Cart{K}|Base|", "method|Cart{K}|.add()|",
        "method|Cart{K}|.check()|", "calls|.add()|.check()|call", "contains|FILE|top{K}()|"]),
    "lua": (".lua", "local m = require('mod{K}')\n-- function ghost() end\nlocal function inner{K}(a)\n  return a\nend\nfunction outer{K}(b)\n  return inner{K}(b)\nend\n",
    ["imports_from|FILE|mod{K}|import", "contains|FILE|inner{K}()|", "contains|FILE|outer{K}()|", "calls|outer{K}()|inner{K}()|call"]),
    "elixir": (".ex", "defmodule Shop{K} do\n  alias Data.Repo\n  def buy(x) do\n    pay(x)\n  end\n\n  defp pay(x) do\n    x\n  end\nend\n",
    ["imports|FILE|data_repo|import", "contains|FILE|Shop{K}|", "method|Shop{K}|.buy()|", "method|Shop{K}|.pay()|", "calls|.buy()|.pay()|call"]),
    "julia": (".jl", "using Base64\nstruct Dot{K} <: Shape\n  x\nend\nfunction area(d)\n  side(d)\nend\nside(d) = d.x\n",
    ["imports|FILE|base64|import", "defines|FILE|Dot{K}|", "inherits|Dot{K}|Shape|", "defines|FILE|area()|", "defines|FILE|side()|", "calls|area()|side()|call"]),
    "fortran": (".f90", "module grid{K}\n  use kinds\ncontains\n  subroutine fill(a)\n    call step(a)\n  end subroutine\n  subroutine step(a)\n  ! call fill(a)\n  end subroutine\nend module\n", [
        "imports|FILE|kinds|import", "defines|FILE|grid{K}|", "method|grid{K}|.fill()|", "method|grid{K}|.step()|", "calls|.fill()|.step()|call"]),
    "verilog": (".v", '`include "defs{K}.vh"\nmodule adder{K}(input a, output b);\n  assign b = a;\nendmodule\nmodule top{K}(input c);\n  adder{K} u1(.a(c));\n  other #(4) u2(c);\nendmodule\n', [
        "imports_from|FILE|defs{K}_vh|import", "contains|FILE|adder{K}|", "contains|FILE|top{K}|", "instantiates|top{K}|adder{K}|", "instantiates|top{K}|other|"]),
    "pascal": (".pas", "unit U{K};\ninterface\nuses SysUtils, Classes;\ntype\n  TBox{K} = class(TBase)\n    procedure Open;\n  end;\nimplementation\nprocedure TBox{K}.Open;\nbegin\n  Help{K}(1);\nend;\nprocedure Help{K}(x: Integer);\nbegin\n  { Open(1) }\nend;\nend.\n", [
        "imports|FILE|sysutils|import", "imports|FILE|classes|import", "contains|FILE|TBox{K}|", "inherits|TBox{K}|TBase|", "contains|FILE|Open()|", "method|TBox{K}|.Open()|",
        "contains|FILE|Help{K}()|", "calls|.Open()|Help{K}()|call"]),
    "groovy": (".groovy", 'import spock.lang.Specification\nclass Spec{K} extends Specification {\n  def "adds numbers"() {\n    expect: sum(1, 2) == 3\n  }\n  def sum(a, b) {\n    return a + b\n  }\n}\n', [
        "imports|FILE|spock_lang_specification|import", "contains|FILE|Spec{K}|", "inherits|Spec{K}|Specification|", "method|Spec{K}|.sum()|", "method|Spec{K}|adds numbers()|"]),
    "bash": (".sh", "#!/bin/bash\nsource lib{K}.sh\nlog{K}() {\n  echo \"main\"\n}\nfunction main {\n  log{K} start\n}\n",
    ["imports_from|FILE|lib{K}_sh|import", "contains|FILE|log{K}()|", "contains|FILE|main()|", "calls|main()|log{K}()|call"]),
    "dart": (".dart", "import 'package:a/b{K}.dart';\nclass Home{K} {\n}\n", ["imports|FILE|package_a_b{K}_dart|import", "defines|FILE|Home{K}|"]),
    "blade": (".blade.php", "@include('parts.nav{K}')\n<livewire:cart{K} />\n<button wire:click=\"buy{K}\">x</button>\n",
    ["includes|FILE|parts_nav{K}|", "uses_component|FILE|cart{K}|", "binds_method|FILE|buy{K}|"]),
    "lazarus_form": (".lfm", "object Form{K}: TForm\n  object Ok{K}: TButton\n    OnClick = OkClick{K}\n  end\nend\n",
    ["contains|FILE|Form{K}|", "contains|FILE|Ok{K}|", "references|FILE|okclick{K}|"]),
    "delphi_form": (".dfm", "inherited Dlg{K}: TDlg\n  object Edit{K}: TEdit\n    OnChange = EditChange{K}\n  end\nend\n",
    ["contains|FILE|Dlg{K}|", "contains|FILE|Edit{K}|", "references|FILE|editchange{K}|"]),
    "lazarus_package": (".lpk", "<Package><Files><Item1><Filename Value=\"u{K}.pas\"/></Item1></Files><RequiredPkgs><Item1><PackageName Value=\"LCL{K}\"/></Item1></RequiredPkgs></Package>\n", ["contains|FILE|u{K}.pas|", "imports|FILE|lcl{K}|import"]),
    "python": (".py", "import os\nfrom pkg.mod{K} import thing\n\nclass Base{K}:\n    pass\n\nclass Item{K}(Base{K}, Outer):\n    \"\"\"A thing that is sold in the shop.\"\"\"\n\n    def price(self, rate: Rate{K}) -> Money:\n        return self.net() + tax{K}(1)\n\n    def net(self):\n        return 'tax(1)'\n\ndef tax{K}(x):\n    # NOTE: rates change\n    return x\n", [
        "imports|FILE|os|import", "imports_from|FILE|pkg_mod{K}|import", "contains|FILE|Base{K}|", "contains|FILE|Item{K}|", "inherits|Item{K}|Base{K}|", "inherits|Item{K}|Outer|",
        "rationale_for|A thing that is sold in the shop.|Item{K}|",
        "method|Item{K}|.price()|", "references|.price()|Rate{K}|parameter_type", "references|.price()|Money|return_type", "method|Item{K}|.net()|", "calls|.price()|.net()|call",
        "contains|FILE|tax{K}()|", "calls|.price()|tax{K}()|call",
        "rationale_for|NOTE: rates change|FILE|"]),
    "sql": (".sql", "CREATE TABLE a{K} (id INT PRIMARY KEY);\nCREATE TABLE b{K} (id INT, a INT REFERENCES a{K}(id));\nCREATE VIEW v{K} AS SELECT * FROM a{K} JOIN b{K} ON 1 = 1;\nCREATE TRIGGER t{K} AFTER INSERT ON b{K} EXECUTE f();\n", [
        "contains|FILE|a{K}|", "contains|FILE|b{K}|", "contains|FILE|v{K}|", "contains|FILE|t{K}|", "references|b{K}|a{K}|", "reads_from|v{K}|a{K}|", "reads_from|v{K}|b{K}|",
        "triggers|t{K}|b{K}|"]),
    "json": (".json", '{"name": "p{K}", "extends": "base{K}", "dependencies": {"left-pad": "1"}, "schema": {"$ref": "other{K}"}}', [
        "contains|FILE|name|", "extends|FILE|base{K}|", "contains|FILE|dependencies|", "imports|dependencies|left_pad|import", "contains|FILE|schema|",
        "references|schema|other{K}|"]),
    "markdown": (".md", "# Top {K}\n\n## Part {K}\n\n```python\n# not a heading\n```\n\n# Next {K}\n",
    ["contains|FILE|Top {K}|", "contains|Top {K}|Part {K}|", "contains|Part {K}|python block 1|", "contains|FILE|Next {K}|"]),
}


def _files(spark, sf, name: str):
    suffix, template, _ = FILES[name]
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("k"), F.concat(F.lit("src/f"), key, F.lit(suffix)).alias("path"), F.replace(F.lit(template), F.lit("{K}"), key).alias("text")
    )


def told(rows):
    """Edges with labels in place of ids; an id that no node has stays."""
    labels = rows.where("kind = 'node'").groupBy("id").agg(F.min("label").alias("label"))
    e = rows.where("kind = 'edge'").select("src", "dst", "relation", "context", "source_file")
    for end in ("src", "dst"):
        e = e.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return e.select("source_file", "relation", F.coalesce("src_label", "src").alias("source"), F.coalesce("dst_label", "dst").alias("target"),
        F.coalesce("context", F.lit("")).alias("context"))


def _sql(name: str) -> str:
    suffix, _, edges = FILES[name]
    rows = []
    for e in edges:
        relation, source, target, context = (x.replace("FILE", "f{K}" + suffix).replace("'", "''") for x in e.split("|"))
        rows.append(f"('{relation}', '{source}', '{target}', '{context}')")
    key = "CAST(n_nationkey AS VARCHAR)"
    return (
        f"SELECT 'src/f' || {key} || '{suffix}' AS source_file, relation, replace(source, '{{K}}', {key}) AS source, replace(target, '{{K}}', {key}) AS target, context\n"
        f"FROM nation, (VALUES {', '.join(rows)}) AS e(relation, source, target, context)"
    )


def _register(name: str) -> None:
    def run(spark, sf):
        return told(X.extract(_files(spark, sf, name).select("path", "text")))

    run.__name__ = f"extract_{name}"
    QUERIES[run.__name__] = run
    ORACLE_SQL[run.__name__] = _sql(name)


for _name in FILES:
    _register(_name)
