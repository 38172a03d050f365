"""Plan shapes shared by operators: chunked order, exact medians, rule lists."""
