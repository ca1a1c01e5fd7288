"""Where rows come from and go to: a store of run tables, and scripted responders."""
