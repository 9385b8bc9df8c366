"""Fixed-width lines for tests."""


def line(
    serial=1, name="CA", residue="ALA", chain="A", number=1, x=0.0, y=0.0, z=0.0, occupancy="1.00", b="10.00",
    element="C", record="ATOM",
):
    return (
        f"{record:<6}{serial:>5} {' ' + name:<4} {residue:>3} {chain:1}{number:>4}    "
        f"{x if isinstance(x, str) else format(x, '.3f'):>8}{y:8.3f}{z:8.3f}{occupancy:>6}{b:>6}          {element:>2}"
    )


def het(*fields, **values):
    return line(*fields, record="HETATM", **values)
