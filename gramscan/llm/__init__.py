"""Training-data operators: toxicity, language-model scores, tokenising, exact and
near dedup, personal data, licences, web archives, decontamination and HTML text.

Nothing outside this subpackage imports it.  Common rules for every operator:

* a null text is an empty text; a null id is a value like any other and never crashes;
* further columns of the input are ignored (or carried along unchanged where a function
  says so), also when their names equal those of result columns;
* an empty input table gives an empty result with the usual columns;
* rows that repeat an id are each given a result row.
"""
