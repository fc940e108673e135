"""Plan shapes shared by the operators: paging, keyed sets, numbering."""
