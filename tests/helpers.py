"""What the test modules share; not in conftest, which other folders have too."""

SMALL = "/root/testdata/sf0.001"
