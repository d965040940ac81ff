"""Writers: GDSII, layer properties, unstructured grids, reports."""
