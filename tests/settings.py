"""Where the tests find the driver's tables."""

SF_SMALL = "/root/testdata/sf0.001"
