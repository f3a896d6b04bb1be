"""Where rows come from and go to: tier tables, state tables, line files."""
