"""How ordered operations are planned: positions, blocks, running totals and halos."""
