"""Facts of models, events, configuration and tests that real sources hold."""

from ripplegraph.sources import java_facts, python_facts

PYTHON = '''
class Line(Model):
    order = models.ForeignKey("Order", on_delete=1)
    class Meta:
        db_table = "lines"

@pytest.fixture
def client(): pass

class Checks(TestCase):
    def test_it(self, client):
        self.assertEqual(1, 1)
        assert True
        bus.trigger("a"); bus.fire("b"); sig.send_robust("c")
        config.get("x"); config.getint("y"); settings.get("z")
'''
JAVA = '''
@Entity
public class Order {
  @Column(name = "nr") private String number;
  @OneToMany(mappedBy = "order") private List<Line> lines;
  @ManyToOne @JoinColumn(name = "shop_id") Shop shop;
  void run() { Other local = make(); }
}
interface Orders extends JpaRepository<Order, Long> {}
'''


def of(rows, *kinds):
    return {(r["fact"], r.get("owner"), r["name"], r.get("target"), r.get("detail")) for r in rows if r["fact"] in kinds}


def test_python():
    rows = list(python_facts.facts(PYTHON))
    assert of(rows, "relationship") == {("relationship", "Line", "order", "Order", "ForeignKey")}
    assert {r["target"] for r in rows if r["fact"] == "model"} == {"lines"}
    assert of(rows, "fixture") == {("fixture", None, "client", None, None)}
    assert {r["name"] for r in rows if r["fact"] == "event"} == {"a", "b", "c"}
    assert {(r["name"], r["detail"]) for r in rows if r["fact"] == "config"} == {("x", "config_file"), ("y", "config_file"), ("z", "settings")}
    assert [r["detail"] for r in rows if r["fact"] == "test"] == ["2"]


def test_java():
    rows = list(java_facts.facts(JAVA))
    assert {(r["name"], r["target"]) for r in rows if r.get("detail") == "composes"} == {("Order", "Line"), ("Order", "Shop")}
    assert of(rows, "field") == {("field", "Order", "number", "nr", "String"), ("field", "Order", "lines", None, "List"), ("field", "Order", "shop", "shop_id", "Shop")}
    assert of(rows, "relationship") == {("relationship", "Order", "lines", "Line", "OneToMany"), ("relationship", "Order", "shop", "Shop", "ManyToOne")}
    assert of(rows, "repository") == {("repository", None, "Orders", "Order", "JpaRepository")}
